"""Collocations against brute force, and the tries by themselves."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from helispan.llm import lookup, phrases
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, phrase string, f long, depth int, blob string"
COLUMNS = "lang rank phrase a l r n score".split()


def _plain(rows, least, top):
    count: dict[str, Counter] = {}
    words: Counter = Counter()
    for r in rows:
        lang = "und" if r[2] is None else r[2]
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (r[1] or "").translate(brute.FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for i in range(len(w)):
                count.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for k in range(1, 5) if i + k <= len(w))
    out = []
    for lang, f in count.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        dropped = set()
        for p, a in candidates.items():
            for i in range(len(p)):
                dropped |= {q for j in range(i + 2, len(p) + 1) if (q := p[i:j]) != p and 100 * a >= 80 * f[q]}
        scored = []
        for p, a in candidates.items():
            if p not in dropped:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, words[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def _rows():
    rng = random.Random(5)
    vocabulary = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(30)] + ["É", "é", "ß", "\x01", "x\x1fy", "New", "new", "york", "#1"]
    fixed = ["New York city hall", "a b", "aa bb cc", "É é", "one two three four five"]
    out = [(1, None, "en"), (2, "", "en"), (3, " \t\n", None), (4, "word", "xx"), (5, "A-B.. ,c;d:e!f?g\x0bh\x0ci\rj\nk", "en"), (6, "the end of" + " the" * 500, "en"), (7, "w" * 5000 + " z", "en")]
    for i in range(400):
        w = []
        for _ in range(rng.randint(0, 40)):
            w.append(rng.choice(fixed) if rng.random() < 0.3 else rng.choice(vocabulary))
            if rng.random() < 0.1:
                w[-1] += rng.choice(".,;:!?\n\r")
        out.append((i, rng.choice([" ", "\t", "  "]).join(w), rng.choice(["en", "en", "de", None, "und", "a b", ""])))
    out += [out[-1], (None, "aa bb cc aa bb cc", "en"), (None, None, None)]
    return [(*r, "p", 1, 2, "x") for r in out]


def _got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.mark.parametrize(("least", "top", "small"), [(30, 2000, False), (3, 2000, True), (5, 7, True)])
def test_brute(spark, rows, monkeypatch, least, top, small):
    if small:
        for name, value in (("SHARD", 500), ("RANGE_WORDS", 300), ("STRIDE", 7), ("SAMPLE_LEAST", 50), ("PIECES", 3), ("RANK_PARTS", 3)):
            monkeypatch.setattr(phrases, name, value)
        monkeypatch.setattr(lookup, "BROADCAST_ROWS", 0)
    wanted = _plain(rows, least, top)
    assert _got(phrases.collocations(spark.createDataFrame(rows, DOCS).repartition(5), least, top)) == wanted
    assert len(wanted) > 10


def test_no_rows(spark):
    assert phrases.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, "few words", None, "", 0, 0, "")], DOCS)).count() == 0


def test_exact_numbers(spark):
    """Products beyond 64 bits."""
    f, l, r = 9_000_000_000_000, 9_000_000_000_001, 9_000_000_000_007
    df = spark.createDataFrame([(f, [l], [r])], "f long, lefts array<long>, rights array<long>").select(phrases._cuts(2)[0].alias("c"))
    assert df.first()["c"]["score"] == 2_000_000 * f // (l + r)


def _trie(paths, counts):
    names = sorted({w for p in paths for w in p})
    number = {w: i for i, w in enumerate(names)}
    table = np.full((len(paths), 5), -1, np.int64)
    for row, p in zip(table, sorted(paths), strict=True):
        row[: len(p)] = [number[w] for w in p]
    return pa.array(names, pa.large_binary()), table, np.array([counts[p] for p in sorted(paths)])


def _listed(words, paths, counts):
    names = words.to_pylist()
    return {tuple(names[i] for i in p if i >= 0): c for p, c in zip(paths.tolist(), counts.tolist(), strict=True)}


def test_tries():
    rng = random.Random(2)
    some = []
    for _ in range(4):
        paths = {tuple(rng.choice([b"a", b"b", b"bb", b"", b"\xff"]) for _ in range(rng.randint(1, 5))) for _ in range(200)}
        some.append({p: rng.choice([1, 300, 70_000, 1 << 40]) for p in paths})
    packed = [phrases.pack(*_trie(list(t), t)) for t in some]
    for t, blob in zip(some, packed, strict=True):
        assert _listed(*phrases.merge([blob])) == t
    merged = phrases.merge(packed)
    total = sum((Counter(t) for t in some), Counter())
    assert _listed(*merged) == total and list(_listed(*merged)) == sorted(total)
    borders = [b"a", b"a b", b"a b zz", b"aa", b"bb \xff a b a", b"zzz", b"\xff\xff"]
    before = [sum(p < tuple(b.split(b" ")) for p in total) for b in borders]
    assert phrases.cut(merged[0], merged[1], [tuple(b.split(b" ")) for b in borders]).tolist() == before


def test_keys_of_wide_columns():
    rng = np.random.default_rng(0)
    paths = rng.integers(-1, 1 << 40, (300, 5))
    paths[::2, :3] = paths[0, :3]
    order = np.argsort(phrases.path_keys(paths), kind="stable")
    assert paths[order].tolist() == sorted(paths.tolist())
