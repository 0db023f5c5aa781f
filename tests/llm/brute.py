"""The contracts, worked out the plain way."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text: str | None, lower: bool = False) -> list[str]:
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fold(doc_id: int | None, of: int) -> int:
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % of


def substring(rows: list[tuple[int, str | None]], window: int = 13) -> list[tuple]:
    least: dict[tuple, float] = {}
    key = lambda i: math.inf if i is None else i
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            least[g] = min(key(i), least.get(g, math.inf))
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < key(i):
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def exact(rows: list[tuple[int, str | None]]) -> list[tuple]:
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, sha(t or "")))
    return out


def lines(rows: list[tuple[int, str | None]], least: int = 40, common: int = 5) -> list[tuple]:
    strip = "\x20\x09\x0a\x0b\x0c\x0d"
    held = defaultdict(set)
    for i, t in rows:
        for key in {line.strip(strip).translate(LOWER) for line in (t or "").split("\n")}:
            if len(key) >= least:
                held[key].add(i)
    out = []
    for i, t in rows:
        kept = []
        all_ = (t or "").split("\n")
        for line in all_:
            ids = held.get(line.strip(strip).translate(LOWER), ())
            last = max((x for x in ids if x is not None), default=None)
            if len(ids) < common or last is None or last == i:
                kept.append(line)
        out.append((i, len(all_), len(all_) - len(kept), sha("\n".join(kept))))
    return out


def shingles(text: str | None, n: int) -> set[tuple]:
    w = words(text, True)
    return ({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}) if w else set()


def jaccard(rows: list[tuple[int, str | None]], n: int = 3, percent: int = 90) -> list[tuple]:
    sets = [shingles(t, n) for _, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def root(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i, j = rows[a][0], rows[b][0]
            if i is not None and j is not None and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(i), root(j)))
                    up[y] = x
    return [(i, len(s), None if i is None else root(i)) for (i, _), s in zip(rows, sets)]


def leaks(rows: list[tuple[int, str | None]], items: list[tuple[int, str | None]], n: int = 5, percent: int = 80) -> list[tuple]:
    out = []
    for i, t in rows:
        w = words(t, True)
        for k, item in items:
            s = shingles(item, n)
            if not s:
                continue
            size = len(next(iter(s)))
            own = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)}
            if 100 * len(s & own) >= percent * len(s):
                out.append((i, k, len(s), len(s & own), len(s & own) / len(s)))
    return out


def lm_base(rows: list[tuple[int, str | None]]) -> list[tuple]:
    counts: Counter = Counter()
    for i, t in rows:
        if fold(i, 5) != 1:
            counts.update([*words(t, True), " "])
    total, kinds = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        tokens = [*words(t, True), " "]
        base = sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in tokens)
        out.append((i, fold(i, 5) == 1, len(tokens), sum(counts[x] > 0 for x in tokens), total, base))
    return out


TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def fill_in_middle(rows: list[tuple[int | None, str | None]], seed: int = 42, rate: int = 50, spm: int = 80) -> list[tuple]:
    out = []
    for i, t in rows:
        t, h = t or "", sha(f"{seed}:{'' if i is None else i}")
        h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
        units = TOKEN.findall(t)
        n = len(units)
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
        if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
            out.append((i, n, "plain", None, None, t))
        elif h4 % 100 < spm:
            out.append((i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"))
        else:
            out.append((i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"))
    return out


def collocations(rows: list[tuple[str | None, str | None]], longest: int = 5, least: int = 100, share: int = 100, top: int = 2000) -> list[tuple]:
    """rows: lang, text."""
    f: dict[str, Counter] = defaultdict(Counter)
    for lang, t in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (t or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                f["und" if lang is None else lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        n = sum(c for g, c in counts.items() if len(g) == 1)
        found = [g for g, c in counts.items() if len(g) > 1 and c >= least]
        over: dict[tuple, int] = {}
        for g in found:
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    over[g[i : i + k]] = max(counts[g], over.get(g[i : i + k], 0))
        scored = []
        for g in found:
            a = counts[g]
            if g not in over or 100 * over[g] < share * a:
                score, _, left, right = min((1000 * a * n // (counts[g[:k]] * counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g)))
                scored.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, k + 1, g.decode(), -a, left, right, n, -score) for k, (score, a, g, left, right) in enumerate(sorted(scored)[:top])]
    return out
