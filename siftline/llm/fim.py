"""Fill-in-middle transformation: each text is cut into prefix, middle and suffix, which change places.

One kernel works on the Arrow UTF-8 buffer of a whole batch. A table of byte classes tells white space; a boundary lies
after a byte that isn't space and stands before one that is, and after each text's last byte. The cumulative sum of
boundaries, less its value where a text begins, numbers the tokens of each text; one searchsorted finds the cuts of all
rows, and one gather moves the bytes. A task only ever holds a slice of its input; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import IS_SPACE, doc_id, flat, slices, texts_of

SEED, RATE, SPM = 42, 50, 80
#: What stands before the prefix, the suffix and the middle of an output.
MARKS = ("<P>", "<S>", "<M>")
PLAIN, PSM_FORM, SPM_FORM = "plain", "psm", "spm"
SLICE = 4 << 20


def boundaries(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether a token ends after each byte."""
    n = len(buf) - 8
    space = IS_SPACE[buf[: n + 1]]
    end = ~space[:n] & space[1 : n + 1]
    last = off[1:][np.diff(off) > 0] - 1
    end[last] = True
    return end


def marked(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each text contains a mark already."""
    n = len(buf) - 8
    letter = np.zeros(256, bool)
    letter[[ord(m[1]) for m in MARKS]] = True
    at = np.flatnonzero((buf[:n] == ord("<")) & letter[buf[1 : n + 1]] & (buf[2 : n + 2] == ord(">")))
    of = np.searchsorted(off, at, "right") - 1
    out = np.zeros(len(off) - 1, bool)
    out[of[at + 3 <= off[of + 1]]] = True
    return out


def cut(texts: pa.Array, draws: np.ndarray, rate: int, spm: int) -> dict[str, pa.Array | np.ndarray]:
    """n, form, prefix_chars, middle_chars and output of each text; draws: four numbers for each, as columns."""
    buf, off = flat(texts)
    begin, finish = off[:-1], off[1:]
    end = boundaries(buf, off)
    ends = np.concatenate([[0], np.cumsum(end)])  # tokens that end before each byte
    n = ends[finish] - ends[begin]
    h1, h2, h3, h4 = draws
    x, y = h1 % (n + 1), h2 % (n + 1)
    plain = (finish == begin) | marked(buf, off) | (h3 % 100 >= rate)

    def place(k: np.ndarray) -> np.ndarray:
        """The byte after each text's k-th token."""
        return np.where(k > 0, np.searchsorted(ends, ends[begin] + k), begin)

    one, two = place(np.minimum(x, y)), place(np.maximum(x, y))
    chars = np.concatenate([[0], np.cumsum((buf[:-8] & 0xC0) != 0x80)])
    first = h4 % 100 < spm
    marks = np.frombuffer("".join(MARKS).encode(), np.uint8)
    source = np.concatenate([buf[:-8], marks])
    at = len(buf) - 8 + 3 * np.arange(3)[:, None] + np.zeros(len(off) - 1, np.int64)
    three = np.where(plain, 0, 3)
    parts = [(begin, one - begin), (two, finish - two), (one, two - one)]  # as MARKS
    mark, part = [(a, three) for a in at], [(a, np.where(plain, 0, m)) for a, m in parts]

    def either(psm: tuple, spm: tuple) -> tuple:
        return tuple(np.where(first, b, a) for a, b in zip(psm, spm))

    # a plain text is one piece
    pieces = [(begin, np.where(plain, finish - begin, 0)), either(mark[0], mark[1]), either(part[0], part[1]), either(mark[1], mark[0]), either(part[1], part[0]), mark[2], part[2]]
    starts, lens = (np.stack([p[i] for p in pieces], 1) for i in (0, 1))
    body, at_ = texts_of(source, starts.ravel(), lens.ravel())
    row_off = at_[:: len(pieces)]
    output = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(row_off.astype(np.int64).tobytes()), pa.py_buffer(body.tobytes())).cast(pa.string())
    return {
        "n": pa.array(n),
        "form": pa.array(np.select([plain, first], [PLAIN, SPM_FORM], PSM_FORM).astype(object), pa.string()),
        "prefix_chars": pa.array(chars[one] - chars[begin], mask=plain),
        "middle_chars": pa.array(chars[two] - chars[one], mask=plain),
        "output": output,
    }


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """Per row: doc_id, n (tokens), form, prefix_chars, middle_chars, output.

    A token is a word with the white space before it, or the white space at a text's end; words are [^\\x20\\x09-\\x0D]+.
    The draws are the first four 8-digit groups of the SHA-256 of "seed:doc_id". The prefix is as many
    tokens as the smaller of h1 and h2 mod (n + 1), the middle goes up to the larger; a text is transformed if h3 mod 100 < rate, in the
    order suffix, prefix, middle (spm) if h4 mod 100 < spm, else prefix, suffix, middle (psm). Empty texts and those with
    a mark stay plain, with null lengths; a null text is empty; a null doc_id draws as an empty name. Rows with one
    doc_id draw alike. Other columns are left out; an empty table gives no rows.
    """
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")))
    digest = F.sha2(name, 256)
    own = F.col("doc_id").cast("long")
    draws = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    base = docs.select(F.coalesce(own, F.lit(0)).alias("did"), own.isNull().alias("none"), F.col("text").cast("string").alias("text"), *draws)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            made = cut(batch.column("text"), np.stack([batch.column(f"h{i + 1}").to_numpy() for i in range(4)]), rate, spm)
            yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("none"), *made.values()], ["did", "none", *made])

    done = base.mapInArrow(run, "did long, none boolean, n long, form string, prefix_chars long, middle_chars long, output string")
    return done.select(doc_id(), "n", "form", "prefix_chars", "middle_chars", "output")


def restored(form: Column, output: Column) -> Column:
    """The exact text, from an output and its form alone."""
    part = F.split(output, "<[PSM]>", -1)
    glued = lambda *at: F.concat(*(part[i] for i in at))
    return F.when(form == SPM_FORM, glued(2, 3, 1)).when(form == PSM_FORM, glued(1, 3, 2)).otherwise(output)
