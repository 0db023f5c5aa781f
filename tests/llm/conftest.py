from __future__ import annotations

import random

import pytest

#: Columns that a corpus may bring along, with names that operators use inside.
CLASHES = "did long, h long, row string, key string, kept boolean, score double, bucket int, gone_id long, own_id long, held_out string, k string"


def corpus() -> list[tuple[int | None, str | None]]:
    """Copies, near copies, shared passages and lines, and all kinds of odd texts."""
    r = random.Random(5)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "ter", "sun", "Vol", "né", "x") for b in ("ra", "tis", "no", "b", "é,", "q.")]
    make = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage, line = make(60), " ".join(make(12)) + " and a long enough tail"
    rows: list[tuple[int | None, str | None]] = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One"), (6, "one two"), (7, "ONE\x0btwo"), (8, "a b c d"), (9, "\n\n"), (10, "x" * 5000),
        (11, " ".join(["same"] * 400)), (12, " ".join(["same"] * 300)), (13, "é" * 40 + "\n" + "é" * 39), (14, "퟿ 😀 zİ"), (None, None), (None, " ".join(passage)), (None, "one two"),
    ]
    for k in range(20, 60):
        w = make(r.randint(0, 120))
        if k % 3 == 0:
            at = r.randint(0, len(w))
            w = w[:at] + passage[r.randint(0, 20) :] + w[at:]
        text = " ".join(w)
        if k % 4 == 0:
            text += f"\n  {line.upper() if k % 8 else line}\t\n" + " ".join(make(5))
        rows.append((k, text))
    base = make(150)
    for k in range(60, 90):  # near copies at all distances
        w = list(base)
        for _ in range(k % 10):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append((k, " ".join(w)))
    for k in range(90, 100):
        rows.append((k, rows[25 + k % 4][1]))
    rows += [(100, " ".join(make(30_000))), (101, "\n".join([line] * 3)), (40, rows[40][1]), (41, rows[41][1]), (41, rows[41][1]), (102, "y\n" * 2000)]
    # the largest and the smallest long, with copies, near copies and shared lines
    ends = make(40)
    rows += [((1 << 63) - 1, " ".join(ends)), (-(1 << 63), " ".join(ends)), (-5, " ".join([*ends, "z"])), ((1 << 63) - 2, f"{line}\n{line}")]
    # a line in many rows of few documents
    few = " ".join(make(9)) + " in two documents, but six rows of them"
    rows += [(103, few)] * 5 + [(104, f"{few}\nmore"), (None, few), (None, few)]
    for k in range(110, 150):  # small sets with near copies
        w = make(6 + k % 9)
        rows += [(k, " ".join(w)), (k + 100, " ".join([*w, "z"])), (k + 200, " ".join(w).upper())]
    return rows


def table(spark, rows, clashing: bool = False):  # noqa: ANN001, ANN201
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    if clashing:
        from pyspark.sql import functions as F

        for c in CLASHES.split(", "):
            name, kind = c.split()
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df.repartition(3)


@pytest.fixture(scope="session")
def rows():  # noqa: ANN201
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):  # noqa: ANN001, ANN201
    from siftline.tables import saved

    return saved(table(spark, rows, clashing=True), "docs")


@pytest.fixture(scope="session")
def none(docs):  # noqa: ANN001, ANN201
    return docs.limit(0)


def same(found, wanted, columns: str) -> None:  # noqa: ANN001
    key = lambda t: tuple((x is None, str(x)) for x in t)
    got = sorted((tuple(r[c] for c in columns.split()) for r in found.collect()), key=key)
    assert got == sorted(wanted, key=key)
