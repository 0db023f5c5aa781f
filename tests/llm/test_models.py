from __future__ import annotations

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftline.llm import brown, language, leaks, packing, quality, toxicity
from siftline.llm.common import documents
from tests.llm import brute
from tests.llm.conftest import same, table

SF = "/root/testdata/sf0.01"


def items(spark, rows):  # noqa: ANN001, ANN201
    return spark.createDataFrame(rows, "item_id long, text string")


def test_leaks(spark, docs, rows, none) -> None:  # noqa: ANN001
    r = random.Random(9)
    held = [(k, " ".join((t or "").split()[a : a + n])) for k, (_, t) in enumerate(rows) if t and (n := r.choice([3, 8, 14, 30, 59])) and (a := r.randint(0, 20)) >= 0]
    held += [(900, None), (901, ""), (902, "one"), (903, "One two"), (904, held[5][1]), (None, held[6][1])]
    for n, percent in ((5, 80), (3, 50)):
        same(leaks.leaks(docs, items(spark, held), n, percent), brute.leaks(rows, held, n, percent), "doc_id item_id item_shingles shared containment")
    assert leaks.leaks(none, items(spark, held)).count() == 0
    assert leaks.leaks(docs, items(spark, [])).count() == 0
    bad = {(i, t) for (i, t), w in ((x, brute.leaks([x], held)) for x in rows) if w}
    left = leaks.without_leaks(docs, items(spark, held))
    assert left.columns == docs.columns
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    assert sorted(((x["doc_id"], x["text"]) for x in left.collect()), key=key) == sorted((x for x in rows if x not in bad), key=key)


def test_leaks_in_blocks(spark, docs, rows, monkeypatch) -> None:  # noqa: ANN001
    held = [(k, " ".join((t or "").split()[3:40])) for k, (_, t) in enumerate(rows)]
    monkeypatch.setattr(leaks, "BLOCK_BYTES", 2000)
    same(leaks.leaks(docs, items(spark, held)), brute.leaks(rows, held), "doc_id item_id item_shingles shared containment")


def test_recall_of_signatures() -> None:
    """Items of all sizes inside long documents, four fifths of each there: candidates by signatures of 128 values at most."""
    r = random.Random(7)
    word = lambda: str(r.randint(0, 10**7))
    hit = tried = 0
    for size in [*range(1, 40), 60, 100, 200, 400, 900]:
        for _ in range(6):
            w = [word() for _ in range(size + 4)]
            items = leaks.Items([0], [" ".join(w)], 5)
            assert all(len(values) <= leaks.BINS for values, _, _ in items.parts.values())
            held = w[: 4 + -(-4 * size // 5)]
            doc = [word() for _ in range(3000)]
            at = r.randrange(3000)
            doc = [*doc[:at], *held, *doc[at:]]
            found = leaks.verified(items, pa.RecordBatch.from_pydict({"text": [" ".join(doc)]}), 0, 80)
            tried += 1
            hit += len(found) == 1 and found[0][3] == len(held) - 4
    assert hit / tried > 0.995


def test_a_short_item_inside_a_long_document(spark) -> None:  # noqa: ANN001
    r = random.Random(2)
    w = [str(r.randint(0, 10**6)) for _ in range(100_000)]
    item = [str(-k) for k in range(14)]
    rows = [(1, " ".join(w)), (2, " ".join([*w[:77_777], *item, *w[77_777:]])), (3, " ".join([*w[:50_000], *item[:12], *w[50_000:]]))]
    found = leaks.leaks(table(spark, rows), items(spark, [(7, " ".join(item))]))
    assert sorted((x["doc_id"], x["shared"]) for x in found.collect()) == [(2, 10), (3, 8)]


def test_lm_base(docs, rows, none) -> None:  # noqa: ANN001
    found = sorted(((r["doc_id"] is None, r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]), r["base_score"]) for r in brown.lm_scores(docs).collect())
    wanted = sorted(((r[0] is None, *r[:5]), r[5]) for r in brute.lm_base(rows))
    assert [x[0] for x in found] == [x[0] for x in wanted]
    assert np.allclose([x[1] for x in found], [x[1] for x in wanted], rtol=1e-9)
    assert brown.lm_scores(none).count() == 0


def test_lm_without_head_words(docs, rows, monkeypatch) -> None:  # noqa: ANN001
    """All counts but a few come from the join."""
    monkeypatch.setattr(brown, "HEAD", 7)
    monkeypatch.setattr(brown, "WORDS", 3)
    test_lm_base(docs, rows, docs.limit(0))


def test_lm_is_a_distribution_and_beats_its_base(spark, monkeypatch) -> None:  # noqa: ANN001
    """Over all words and the end, probabilities after any word sum to 1; on held-out text, the classes help."""
    r = random.Random(4)
    nouns, verbs = [f"n{k}" for k in range(40)], [f"v{k}" for k in range(40)]
    text = lambda: " ".join(x for _ in range(20) for x in (r.choice(nouns), r.choice(verbs)))
    monkeypatch.setattr(brown, "CLASSES", 4)
    found = brown.lm_scores(table(spark, [(k, text()) for k in range(120)])).collect()
    held = [x for x in found if x["held_out"]]
    assert sum(x["score"] for x in held) > sum(x["base_score"] for x in held) + 5 * len(held)
    known = [(k, "a b a c b") for k in range(20)]
    probe = [(10_000 + 7919 * k, w) for k, w in enumerate(("a", "b", "c", ""))]
    held_ids = [i for i in range(10_000, 200_000) if brute.fold(i, 5) == 1][:4]
    probe = list(zip(held_ids, ("a", "b", "c", "")))
    first = {x["doc_id"]: x["score"] for x in brown.lm_scores(table(spark, known + probe)).collect()}
    assert all(s <= 0 for s in first.values())
    assert sum(10 ** first[i] for i in held_ids) < 1


def test_lm_scores_against_the_plain_way(spark, monkeypatch) -> None:  # noqa: ANN001
    """All words are units here, so the exchange settles the classes; the rest is worked out with dictionaries. Over all
    words, the end and an unknown word of each ending, probabilities after any word sum to 1."""
    r = random.Random(14)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi") for b in ("ra", "tis", "no", "é")]
    rows = [(k, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 25)))) for k in range(150)]
    rows += [(k, f"ka new{k} {r.choice(vocabulary)} Lotis") for k in range(150, 170)] + [(None, "kara mino"), (200, None), (200, "x kara"), (201, rows[0][1])]
    monkeypatch.setattr(brown, "CLASSES", 5)
    train = [[*brute.words(t, True), " "] for i, t in rows if brute.fold(i, 5) != 1]
    n = Counter(w for t in train for w in t)
    order = sorted((w for w in n if w != " "), key=lambda w: (-n[w], w.encode()))
    first, end = brown.WORDS, brown.WORDS + brown.SUFFIXES
    unit = {w: k for k, w in enumerate(order)} | {" ": end}
    bigrams = np.zeros((end + 1, end + 1))
    for t in train:
        for a, b in zip([" ", *t], t):
            bigrams[unit[a], unit[b]] += 1
    of = brown.exchange(bigrams, 5).tolist()
    steps: Counter = Counter()
    for t in train:
        for a, b in zip([" ", *t], t):
            steps[of[unit[a]], of[unit[b]]] += 1
    total = sum(steps.values())
    own = [(sum(steps[a, c] for a in range(5)) + 0.5) / (total + 0.5 * 5) for c in range(5)]
    step = lambda a, b: (steps[a, b] + brown.BACK * own[b]) / (sum(steps[a, c] for c in range(5)) + brown.BACK)
    mass = [0.0] * 5
    for w, k in n.items():
        mass[of[unit[w]]] += k + 0.5
    for e in range(first, end):
        mass[of[e]] += 0.5

    def ending(w: str) -> int:
        b = np.frombuffer(w.encode(), np.uint8)
        return first + int(brown.suffix_unit(b, np.array([0]), np.array([len(b)]))[0])

    cls = lambda w: of[unit[w]] if w in n else of[ending(w)]
    p = lambda a, w: step(cls(a), cls(w)) * (n[w] + 0.5) / mass[cls(w)]
    for a in (" ", "kara", "nothing"):
        unknown = sum(step(cls(a), of[e]) * 0.5 / mass[of[e]] for e in range(first, end))
        assert math.isclose(sum(p(a, w) for w in n) + unknown, 1.0, rel_tol=1e-9)
    wanted = []
    for i, t in rows:
        t = [*brute.words(t, True), " "]
        wanted.append((i is None, i or 0, sum(math.log10(p(a, w)) for a, w in zip([" ", *t], t))))
    got = sorted((x["doc_id"] is None, x["doc_id"] or 0, x["score"]) for x in brown.lm_scores(table(spark, rows)).collect())
    assert [x[:2] for x in got] == [x[:2] for x in sorted(wanted)]
    assert np.allclose([x[2] for x in got], [x[2] for x in sorted(wanted)], rtol=1e-9)


def test_lm_classes_of_rare_words(spark, monkeypatch) -> None:  # noqa: ANN001
    """Two kinds of words take turns; all end alike and most aren't units, so only classes of their own tell them apart."""
    r = random.Random(6)
    kinds = [f"a{k}zz" for k in range(150)], [f"b{k}zz" for k in range(150)]
    text = lambda k: " ".join(r.choice(kinds[i % 2]) for i in range(30)) + f" once{k}zz"
    rows = [(k, text(k)) for k in range(300)]
    monkeypatch.setattr(brown, "WORDS", 60)
    monkeypatch.setattr(brown, "CLASSES", 4)
    for head in (200, brown.HEAD):
        monkeypatch.setattr(brown, "HEAD", head)
        held = [x for x in brown.lm_scores(table(spark, rows)).collect() if x["held_out"]]
        # the known kind of each word is worth up to log10(2) = 0.3
        assert np.mean([(x["score"] - x["base_score"]) / x["n_tokens"] for x in held]) > 0.15
        scores = sorted((x["doc_id"], x["score"]) for x in held)
        if head == 200:
            joined = scores
    assert np.allclose(joined, scores, rtol=1e-9)


def test_head_words_of_flat_counts(spark) -> None:  # noqa: ANN001
    words = spark.range(4000).selectExpr("cast(cast(id as string) as binary) as word", "if(id < 10, 900L, 3L) as n")
    found = brown.head_words(words, 1000).collect()
    assert 900 < len(found) < 1100 and sum(x["n"] == 900 for x in found) == 10
    assert brown.head_words(words, 5000).count() == 4000


def test_exchange_finds_classes() -> None:
    """Three kinds of words that follow one another in a ring."""
    b = np.zeros((18, 18))
    for i, j in itertools.product(range(18), range(18)):
        if j % 3 == (i + 1) % 3:
            b[i, j] = 10 + (i * j) % 3
    of = brown.exchange(b, 4)
    assert all(len({k % 3 for k in range(18) if of[k] == c}) <= 1 for c in range(4))


def test_toxicity(spark, docs, none) -> None:  # noqa: ANN001
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = toxicity.toxicity(documents(spark, SF), labels)
    own = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    seen = [(own[r["doc_id"]], r["predicted"], r["held_out"], r["score"]) for r in found.collect() if r["doc_id"] in own]
    assert all((brute.fold(r["doc_id"], 4) == 2) == r["held_out"] for r in found.collect())
    held = [x for x in seen if x[2]]
    assert sum(a == b for a, b, *_ in held) / len(held) > 0.95
    assert all(0 <= x[3] <= 1 and x[1] == (x[3] >= 0.3) for x in seen)
    odd = toxicity.toxicity(docs, labels)
    assert odd.count() == docs.count()
    assert toxicity.toxicity(none, labels).count() == 0
    assert toxicity.without_toxic(none, labels).count() == 0
    nobody = toxicity.toxicity(docs, labels.limit(0))
    assert nobody.count() == docs.count()
    assert toxicity.without_toxic(docs, labels).columns == docs.columns


def test_gapped_insults(spark) -> None:  # noqa: ANN001
    r = random.Random(8)
    word = lambda: "".join(r.choice("aeioulrtnsmdk") for _ in range(r.randint(2, 8)))
    clean = [" ".join(word() for _ in range(60)) for _ in range(300)]
    insults = ("blockhead", "dunderpate", "nitwit")
    toxic = [t[:100] + f" {r.choice(insults)} " + t[100:] + f" {r.choice(insults)}." for t in clean[:60]]
    s = toxicity.trained(toxic, clean[60:], 0.15)
    assert (s.scores(toxic) >= 0.3).mean() > 0.95
    fresh = [" ".join(word() for _ in range(30)) for _ in range(200)]
    assert (s.scores(fresh) < 0.3).mean() > 0.97
    for w in ("bl-ockhe.ad", "blockxhead", "d u n d e r p a t e", "NITWIT!!", "nit.wit", "dundeerpate"):
        assert s.scores([f"{fresh[0]} you {w} and {w}."])[0] >= 0.3, w


def test_kernel_against_its_definition() -> None:
    """The sum over common subsequences of LENGTH characters, by their spans."""
    k = toxicity.Kernel(["^abcab", "bcda"])
    for word in ("abcab", "axbcab", "bcdabcda", "zzz", "a" * 9):
        rows, _ = k.rows(["^" + word])
        for mark, ids in zip(k.landmarks, k.marks):
            wanted = 0.0
            for s in itertools.combinations(range(len(word) + 1), toxicity.LENGTH):
                for t in itertools.combinations(range(len(mark)), toxicity.LENGTH):
                    if [("^" + word)[i] for i in s] == [mark[i] for i in t]:
                        wanted += toxicity.DECAY ** (s[-1] - s[0] + 1 + t[-1] - t[0] + 1)
            assert math.isclose(float(k.raw(rows, ids)[0]), wanted, abs_tol=1e-12)


def test_scores_against_the_definition() -> None:
    """Whole scores of a trained model, by the kernel's definition word by word."""
    r = random.Random(18)
    word = lambda: "".join(r.choice("aeiourtnsm") for _ in range(r.randint(2, 7)))
    clean = [" ".join(word() for _ in range(40)) for _ in range(120)]
    toxic = [f"{t} dunderpate. {word()} nitwit!" for t in clean[:30]]
    s = toxicity.trained(toxic, clean[30:], 0.2)

    def raw(word: str, mark: str) -> float:
        """The sum over pairs of equal subsequences: the last matches at (i, j), weighted by what is spanned."""
        d, size = toxicity.DECAY, toxicity.LENGTH
        last: dict[tuple[int, int, int], float] = {}
        for k in range(size):
            for i, x in enumerate(word):
                for j, y in enumerate(mark):
                    if x == y:
                        last[k, i, j] = d * d * (1 if not k else sum(last.get((k - 1, a, b), 0.0) * d ** (i - a - 1 + j - b - 1) for a in range(i) for b in range(j)))
        return sum(v for (k, _, _), v in last.items() if k == size - 1)

    own = [raw(m, m) for m in s.kernel.landmarks]

    def like(word: str) -> dict[int, float]:
        p = toxicity.plain(word)
        out: dict[int, float] = {}
        if len(p) >= toxicity.LENGTH - 1:
            p, half = toxicity.START + p, toxicity.SPAN // 2
            for a in range(0, max(1, len(p) - half), half):
                for k, m in enumerate(s.kernel.landmarks):
                    v = min(raw(p[a : a + toxicity.SPAN], m) / own[k], 1.0)
                    if v >= toxicity.FLOOR:
                        out[k] = max(v, out.get(k, 0.0))
        return out

    for text in [*toxic[:3], *clean[:2], "", "d u n d e r p a t e you. Nit-wit and dun.derpate!", "x" * 40 + "nitwit", "nitwit " * 9]:
        rows, words = [], {}
        for sentence in toxicity.sentences(text):
            row: dict[int, float] = {}
            for w in sentence:
                for k, v in like(w).items():
                    row[k] = max(v, row.get(k, 0.0))
                if like(w):
                    words[toxicity.plain(w)] = like(w)
            if row:
                rows.append(row)
        decide = lambda row: max(0.0, sum(s.weights[k] * v for k, v in row.items()) - toxicity.FAINT)
        worst, n = max(map(decide, rows), default=0.0), len(text.split())
        found = sum(map(decide, words.values()))
        x = [worst, max(0.0, worst - 0.8), max(0.0, worst - 1.2), math.log1p(sum(map(decide, rows))), math.log1p(found), found / (1 + n / 100), math.log1p(n) / 4]
        wanted = 1 / (1 + math.exp(-(sum(a * b for a, b in zip(x, s.last)) + s.last[-1])))
        assert math.isclose(s.scores([text])[0], wanted, rel_tol=1e-9), text


def test_landmarks_of_many_letters() -> None:
    """All of 300 different characters count."""
    marks = ["".join(chr(0x4E00 + 7 * k + j) for j in range(7)) for k in range(48)]
    k = toxicity.Kernel(marks)
    assert (k.own > 0).all()
    k.look_at(set(marks))
    assert all(k.like[m][0][0] == i for i, m in enumerate(marks))


def test_strings_of_long_words_are_counted() -> None:
    h, n, place, flat = toxicity.grams_of("x" * 5000 + "blockhead blockhead. b-lockhead")
    named = {flat[a : a + k]: int(c) for (a, k), c in zip(place.tolist(), n.tolist())}
    assert named["khead"] == 3 and named["^bloc"] == 2 and len(named) == len(h)
    assert toxicity.grams_of("")[0].size == 0


def test_long_labelled_texts_teach(spark) -> None:  # noqa: ANN001
    """The only toxic examples are longer than 32 KB; what they say is learned."""
    r = random.Random(13)
    word = lambda: "".join(r.choice("aeioulrtnsmdk") for _ in range(r.randint(2, 8)))
    rows = [(k, " ".join(word() for _ in range(7000 if k < 12 else 60)), int(k < 12)) for k in range(400)]
    rows = [(k, f"{t} dunderpate. " * (1 if y else 0) + t * (not y) + " you dunderpate" * y, y) for k, t, y in rows]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    s = toxicity.learned(docs, labels)
    assert s.kernel and any(m.strip("^") in "dunderpate" for m in s.kernel.landmarks)


def test_long_words_are_seen_whole() -> None:
    k = toxicity.Kernel(["^idiot"])
    k.look_at({"x" * 5000 + "idiot" + "y" * 5000, "x" * 30})
    assert list(k.like) == ["x" * 5000 + "idiot" + "y" * 5000]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 50), min_size=1, max_size=9), st.integers(1, 5))
def test_bounds_are_optimal(histogram: dict[int, int], buckets: int) -> None:
    lengths, counts = np.array(list(histogram)), np.array(list(histogram.values()))

    def padding(ends: tuple) -> int:
        return sum(n * (min(e for e in ends if e >= x) - x) for x, n in histogram.items())

    top = max(histogram)
    best = min(padding((*c, top)) for k in range(min(buckets, len(histogram))) for c in itertools.combinations(sorted(histogram)[:-1], k))
    ends = packing.bounds(lengths, counts, buckets)
    assert len(ends) <= buckets and ends == sorted(ends) and ends[-1] == top
    assert padding(tuple(ends)) == best


def test_packing(docs, rows, none) -> None:  # noqa: ANN001
    longest, budget = 64, 256
    found = packing.pack(docs, longest, 4, budget, with_text=True).collect()
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(" ".join([*brute.words(t), "</s>"]))
    batches = defaultdict(list)
    pieces = defaultdict(list)
    for r in found:
        assert 0 < r["n_tokens"] <= r["bucket_len"] <= longest and r["padding"] == r["bucket_len"] - r["n_tokens"]
        assert len(r["tokens"].split(" ")) == r["n_tokens"] and r["first_token"] == r["piece"] * longest
        batches[r["bucket"], r["batch"]].append((r["slot"], r["bucket_len"]))
        pieces[r["doc_id"]].append((r["piece"], r["tokens"]))
    for i, t in texts.items():
        if len(t) == 1:
            assert " ".join(x for _, x in sorted(pieces[i])) == t[0]
        assert sum(len(x.split(" ")) for _, x in pieces[i]) == sum(len(x.split(" ")) for x in t)
    fill = defaultdict(list)
    for (bucket, batch), slots in batches.items():
        assert sorted(s for s, _ in slots) == list(range(len(slots)))
        assert len(slots) * slots[0][1] <= budget
        fill[bucket].append((batch, len(slots), budget // slots[0][1]))
    for held in fill.values():  # only a bucket's last batch may have room
        held.sort()
        assert [b for b, _, _ in held] == list(range(len(held))) and all(n == most for _, n, most in held[:-1])
    assert packing.pack(none).count() == 0


def test_language(spark, docs, none) -> None:  # noqa: ANN001
    whole = documents(spark, SF)
    own = {r["doc_id"]: r["lang"] for r in whole.select("doc_id", "lang").collect()}
    found = language.languages(whole).collect()
    assert all(r["held_out"] == (brute.fold(r["doc_id"], 3) == 1) for r in found)
    assert np.mean([own[r["doc_id"]] == r["lang_pred"] for r in found if r["held_out"]]) > 0.98
    odd = {(r["doc_id"]): r for r in language.languages(docs).collect()}
    assert [odd[k]["lang_pred"] for k in (1, 2, 3, 9)] == ["und"] * 4
    assert odd[4]["lang_pred"] == "en"
    assert language.languages(none).count() == 0
    assert {r["lang_pred"] for r in language.languages(docs.drop("lang").selectExpr("*", "cast(null as string) as lang")).collect()} == {"und"}


def test_languages_of_few_texts_with_many_copies(spark) -> None:  # noqa: ANN001
    """Each is learned, with no text twice, however the texts' hashes fall."""
    few = {f"l{k}": [" ".join(f"{a}{b}{a}" for b in "aeiou") + f" {a * n}" for n in range(1, 4)] for k, a in enumerate("bcdfghjk")}
    rows = [(lang, t) for lang, texts in few.items() for t in texts * 100] + [("many", f"x{chr(97 + k % 26)}{chr(97 + k // 26)}") for k in range(400)]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    assert language.learned(docs, 20).langs == sorted([*few, "many"])
    drawn = language.sample(docs.select("lang", "text"), 20).collect()
    assert {lang: sorted(r["text"] for r in drawn if r["lang"] == lang) for lang in few} == {k: sorted(v) for k, v in few.items()}
    assert not any(r["calibrates"] for r in drawn if r["lang"] in few)
    assert sum(r["lang"] == "many" for r in drawn) == 20 and sum(r["calibrates"] for r in drawn) == 2
    own = dict(zip(range(len(rows)), rows))
    assert all(r["lang_pred"] == own[r["doc_id"]][0] for r in language.languages(docs, rows=20).collect() if own[r["doc_id"]][0] in few)


def test_kneser_ney_sums_to_one() -> None:
    ids = np.zeros(0x110000, np.uint16)
    for k, c in enumerate("abc"):
        ids[ord(c)] = k + 2
    chars, off, letters = language.codes(["abcabcaab b", "", "c!!c"], ids)
    assert letters.tolist() == [10, 0, 2] and np.diff(off).tolist() == [11, 0, 3]
    found, n = np.unique(language.grams(chars, off), axis=1, return_counts=True)
    m = language.Model(found, n, 4)
    for context in ((0, 0, 0, 0), (2, 0, 0, 0), (3, 2, 0, 0), (2, 2, 4, 4)):
        rows = np.array([[c, *context] for c in range(5)], np.uint32).T
        p = np.exp(m.log(language.hashed(rows), language.hashed(rows[1:])))
        assert math.isclose(p.sum(), 1.0, rel_tol=1e-9)


def test_language_against_counts_by_name(spark) -> None:  # noqa: ANN001
    """The whole query against interpolated Kneser-Ney worked out with dictionaries."""
    r = random.Random(12)
    kinds = {"aa": "abcdef", "bb": "abxyzé", "cc": "жзик"}
    rows = [(k, lang, " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 6))) for _ in range(r.randint(1, 12)))) for k in range(240) for lang, letters in [r.choice(list(kinds.items()))]]
    rows += [(300, "aa", None), (301, None, "abc abc"), (302, "bb", "123")]
    docs = spark.createDataFrame([(i, t, lang) for i, lang, t in rows], "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in language.languages(docs).collect()}
    taken = {(x["lang"], x["text"]) for x in language.sample(docs.where("lang IS NOT NULL").selectExpr("doc_id", "lang", "coalesce(text, '') AS text").where(~language.in_fold(1, 3)).select("lang", "text")).where("not calibrates").collect()}
    letters = {c for lang, t in {(lang, t or "") for i, lang, t in rows if lang and brute.fold(i, 3) != 1} for c in t if c.isalpha()}

    def chars(t: str | None) -> list[str]:
        out: list[str] = []
        for c in t or "":
            c = c if c in letters else "?" if c.isalpha() else " "
            if c != " " or out and out[-1] != " ":
                out.append(c)
        return out

    def model(lang: str):  # noqa: ANN202
        orders = [Counter() for _ in range(6)]
        for own, t in taken:
            if own == lang:
                c = [" "] * 4 + chars(t)
                orders[5].update(tuple(c[i - 4 : i + 1]) for i in range(4, len(c)))
        for k in range(4, 0, -1):
            orders[k] = Counter(g[1:] for g in orders[k + 1])

        def p(g: tuple) -> float:
            if not g:
                return 1 / (len(letters) + 3)
            table = orders[len(g)]
            ones, twos = (sum(n == k for n in table.values()) for k in (1, 2))
            less = ones / (ones + 2 * twos) if ones and twos else 0.5
            same = [n for x, n in table.items() if x[:-1] == g[:-1]]
            return (max(table[g] - less, 0) + less * len(same) * p(g[1:])) / sum(same) if same else p(g[1:])

        return p

    models = {lang: model(lang) for lang in kinds}
    for i, _, t in rows:
        c = chars(t)
        if not any(x != " " for x in c):
            assert got[i]["lang_pred"] == "und" and got[i]["score"] == 0
            continue
        if i % 6 and t:  # a sixth is enough
            continue
        padded = [" "] * 4 + c
        cross = {lang: -sum(math.log(p(tuple(padded[k - 4 : k + 1]))) for k in range(4, len(padded))) / len(c) for lang, p in models.items()}
        best = min(cross, key=lambda lang: (cross[lang], lang))
        assert got[i]["lang_pred"] == best
        assert math.isclose(got[i]["cross_entropy"], cross[best], rel_tol=1e-9)


def test_letters_of_a_large_alphabet_are_told_apart() -> None:
    """Languages that differ only in which of 12,000 letters they have."""
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 12_000)]
    ids = np.zeros(0x110000, np.uint32)
    ids[[ord(c) for c in letters]] = [ord(c) for c in letters]
    models = []
    for part in (letters[::2], letters[1::2]):
        chars, off, _ = language.codes(["".join(part)], ids)
        found, n = np.unique(language.grams(chars, off), axis=1, return_counts=True)
        models.append(language.Model(found, n, len(letters) + 2))
    chars, off, n = language.codes([letters[11_998], letters[11_999]], ids)
    assert n.tolist() == [1, 1]
    assert language.entropies(models, chars, off).argmin(1).tolist() == [0, 1]


def test_shares_of_very_many_rows_are_not_zero(spark) -> None:  # noqa: ANN001
    from siftline.llm.common import limit_of, sampled

    for count in (10**10, 10**12, 10**18):
        assert math.isclose(limit_of(2000 / count) / 2**63, 2000 / count, rel_tol=0.01)
    assert limit_of(1e-30) == 1 and limit_of(0.0) == 0
    assert spark.range(1000).where(sampled(1.0, "id")).count() == 1000
    assert spark.range(1000).where(sampled(0.0, "id")).count() == 0
    assert 300 < spark.range(1000).where(sampled(0.4, "id")).count() < 500


def test_quality(spark, docs, none) -> None:  # noqa: ANN001
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    found = [r for r in quality.quality(documents(spark, SF)).collect() if r["doc_id"] in labels]
    good = [r["keep"] for r in found if labels[r["doc_id"]] == 1]
    bad = [r["keep"] for r in found if labels[r["doc_id"]] == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.4
    assert quality.quality(docs).count() == docs.count()
    assert quality.quality(none).count() == 0
    assert not any(r["keep"] or r["score"] for r in quality.quality(docs).where("n_words = 0").collect())


def plain_votes(text: str) -> tuple[list[int], list[str]]:
    """The labellers' votes by their definitions: 0 nothing, 1 bad, 2 good."""
    w = brute.words(text)
    n = len(w)
    ascii_marks = {c for c in map(chr, range(33, 127)) if not c.isalnum()}
    raw = text.encode()
    visible = sum(b not in b" \t\n\x0b\x0c\r" for b in raw)
    letters = sum(chr(b) in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" for b in raw)
    again = [k > 0 and w[k] == w[k - 1] for k in range(n)]
    share = lambda flags: sum(flags) / max(n, 1)
    lines = [x for x in text.encode().splitlines(keepends=True) if len(x) >= 10]
    bare = [x.rstrip(b"\n") for x in lines]
    found = {
        "symbols": sum(chr(b) in ascii_marks - set(".,;:'\"()-?") for b in raw) / max(visible, 1),
        "capitals": sum(65 <= b <= 90 for b in raw) / max(letters, 1),
        "repeats": share(again),
        "runs": share([again[k] and k > 0 and again[k - 1] for k in range(n)]),
        "tails": share([len(x.encode()) > 1 and x[-1] in ascii_marks and x[-1] == x[-2] for x in w]),
        "marks": share([x[0] in ascii_marks and x[-1] in ascii_marks and len(x.encode()) <= 2 for x in w]),
        "distinct": len(set(w)) / max(n, 1) ** 0.9,
        "length": visible / max(n, 1),
        "stops": share([x[-1] in ".!?" for x in w]),
        "lines": sum(x in bare[:k] for k, x in enumerate(bare)) / max(len(bare), 1),
    }
    out = []
    for name, (bad, good) in quality.LABELLERS.items():
        inside = lambda low, high, x=found[name]: (low is None or x >= low) and (high is None or x <= high)
        vote = 1 if inside(*bad) else 2 if inside(*good) else 0
        out.append(vote if n >= quality.NEEDS.get(name, 1) else 0)
    return out, w


def test_quality_against_the_plain_way(spark) -> None:  # noqa: ANN001
    """Votes, expectation-maximisation and scorer of a small corpus, worked out with lists and dictionaries."""
    r = random.Random(31)
    words = [f"{a}{b}" for a in ("Ka", "lo", "mi", "ter") for b in ("ra", "tis.", "no", "b,")]
    rows = []
    for k in range(60):
        w = [r.choice(words) for _ in range(r.randint(0, 90))]
        if k % 4 == 1:
            w = [x.upper() + "!!" for x in w]
        if k % 4 == 2:
            w = [x for y in w for x in (y, y, y)]
        text = " ".join(w)
        rows.append((k, text + ("\na line of some length" * 3 if k % 5 == 0 else "") + (" ## %% @@ <>" * 5 if k % 7 == 0 else "")))
    got = {x["doc_id"]: x for x in quality.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    plain = {i: plain_votes(t) for i, t in rows}
    voters = [v for v, w in plain.values() if w]
    names = range(len(quality.LABELLERS))
    bad, good, prior = [0.5] * len(names), [0.05] * len(names), 0.8
    post: list[float] = []
    for _ in range(300):
        new = []
        for v in voters:
            odds = math.log((1 - prior) / prior)
            for j in names:
                odds += math.log(bad[j] / good[j]) if v[j] == 1 else math.log((1 - bad[j]) / (1 - good[j])) if v[j] == 2 else 0
            new.append(1 / (1 + math.exp(odds)))
        done = post and max(abs(a - b) for a, b in zip(new, post)) < 1e-9
        post = new
        if done:
            break
        for table, weight, start in ((bad, [1 - p for p in post], 0.5), (good, post, 0.05)):
            for j in names:
                hit = sum(p for p, v in zip(weight, voters) if v[j] == 1)
                table[j] = (hit + start * 10) / (sum(p for p, v in zip(weight, voters) if v[j]) + 10)
        for j in names:
            good[j] = min(good[j], quality.FALSE_ALARMS)
        prior = min(max((sum(post) + 8) / (len(voters) + 10), 0.01), 0.99)
    of = dict(zip([i for i, (v, w) in plain.items() if w], post))
    assert [got[i]["n_words"] for i, _ in rows] == [len(plain[i][1]) for i, _ in rows]
    assert all(math.isclose(got[i]["posterior"], of.get(i, 0.0), abs_tol=1e-6) for i, _ in rows)
    assert all((got[i]["score"] >= 0.5) == got[i]["keep"] for i, _ in rows)
    # the scorer learns what the posteriors say, and only from words and their shapes
    sure = [i for i in of if abs(of[i] - 0.5) > 0.4]
    assert np.mean([(of[i] > 0.5) == got[i]["keep"] for i in sure]) > 0.9
    same_words: dict[tuple, float] = {}
    for i, t in rows:
        assert math.isclose(same_words.setdefault(tuple(brute.words(t)), got[i]["score"]), got[i]["score"])


def test_scorer_against_dictionaries() -> None:
    """Logistic AdaGrad on a few sparse rows."""
    rows = [(0.9, np.array([3, 70]), np.array([0.5, 0.25])), (0.1, np.array([3, 9]), np.array([0.2, 0.8])), (0.7, np.array([70]), np.array([1.0]))]
    w, b = quality.trained(rows, 4)
    weights: dict[int, float] = defaultdict(float)
    seen: dict[int, float] = defaultdict(lambda: 1e-6)
    bias, seen_bias = 0.0, 1e-6
    order = np.random.default_rng(7)
    for _ in range(4):
        for i in order.permutation(3).tolist():
            y, at, x = rows[i]
            g = 1 / (1 + math.exp(-(bias + sum(weights[k] * v for k, v in zip(at.tolist(), x.tolist()))))) - y
            for k, v in zip(at.tolist(), x.tolist()):
                step = g * v + 1e-7 * weights[k]
                seen[k] += step * step
                weights[k] -= 0.7 * step / math.sqrt(seen[k])
            seen_bias += g * g
            bias -= 0.3 * g / math.sqrt(seen_bias)
    assert math.isclose(b, bias, rel_tol=1e-9) and all(math.isclose(w[k], v, rel_tol=1e-9) for k, v in weights.items())


def test_em_recovers_accuracies() -> None:
    r = np.random.default_rng(1)
    names = len(quality.LABELLERS)
    good = r.random(40_000) < 0.7
    hit, alarm = np.linspace(0.3, 0.9, names), np.linspace(0.002, 0.015, names)
    says_bad = r.random((len(good), names)) < np.where(good[:, None], alarm, hit)
    votes = np.where(r.random((len(good), names)) < 0.3, 0, np.where(says_bad, 1, 2))
    patterns, n = np.unique((votes * 3 ** np.arange(names - 1, -1, -1)).sum(1), return_counts=True)
    post, table_, prior = quality.posteriors(patterns, n.astype(float))
    assert abs(prior - 0.7) < 0.03
    assert np.abs(table_[:, 0] - hit).max() < 0.05 and np.abs(table_[:, 1] - alarm).max() < 0.01


@pytest.mark.parametrize("texts", [["", "a", "a a a"], ["x" * 50_000, "\n\n", "é"]])
def test_measures_of_odd_texts(texts: list[str]) -> None:
    found, n, *_ = quality.measures(pa.RecordBatch.from_pydict({"text": texts}))
    assert all(len(v) == len(texts) and np.isfinite(v).all() for v in found.values())
    assert n.tolist() == [len(t.split()) for t in texts]
