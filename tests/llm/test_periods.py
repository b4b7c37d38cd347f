"""Periodic runs against brute force over all periods."""

from __future__ import annotations

import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest

from helispan.llm import periods, queries

DOCS = "doc_id long, text string, lang string, runs int, start long, n_words string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w, length, exponent):
    out = []
    for q in range(1, len(w)):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            # The smallest period of a stretch of two periods or more divides any other that it goes on for.
            if j > i and n >= max(length, exponent * q) and not any(all(w[k] == w[k + p] for k in range(i, i + n - p)) for p in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def _plain(doc_id, text):
    w = WORD.findall(text or "")
    if doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(w, 24, 3)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    kept = " ".join(x for i, x in enumerate(w) if i not in drop)
    return (doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept))


COLUMNS = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()


def _got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("length", "exponent"), [(2, 2), (5, 2), (6, 3), (24, 3), (9, 4)])
def test_small_alphabets(length, exponent):
    rng = random.Random(length * 10 + exponent)
    texts = [[]]
    for _ in range(150):
        letters = rng.choice([1, 2, 2, 3])
        root = [rng.randrange(letters) for _ in range(rng.randint(1, 9))]
        w = [rng.randrange(letters) for _ in range(rng.randint(0, 30))] + root * rng.randint(1, 12) + root[: rng.randint(0, len(root))]
        texts.append(w + [rng.randrange(letters) for _ in range(rng.randint(0, 30))])
    # Fibonacci and Thue-Morse words are rich in runs.
    a, b = [0], [0, 1]
    while len(b) < 200:
        a, b = b, b + a
    texts += [b, [bin(i).count("1") % 2 for i in range(256)], []]
    first = np.cumsum([0] + [len(t) for t in texts])
    ids = np.array([x for t in texts for x in t], np.int64)
    rows = periods.find_runs(ids, first, length, exponent).tolist()
    assert rows == [[t, *r] for t, w in enumerate(texts) for r in brute_runs(w, length, exponent)]


def test_tables():
    rng = np.random.default_rng(1)
    values = rng.permutation(500)
    assert periods.next_smaller(values).tolist() == [next((j for j in range(i + 1, 500) if values[j] < values[i]), 500) for i in range(500)]
    ids, first = rng.integers(0, 2, 400), np.array([0, 130, 130, 400])
    common = periods.Extensions(ids, first).common
    a, b = rng.integers(0, 400, 300), rng.integers(0, 400, 300)
    apart = (a != b) & ((a < 130) == (b < 130))
    a, b = a[apart], b[apart]

    def plain(x, y):
        stop, k = 130 if x < 130 else 400, 0
        while max(x, y) + k < stop and ids[x + k] == ids[y + k]:
            k += 1
        return k

    assert common(a, b).tolist() == [plain(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def _texts():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "\x0bü", "a,b"]
    out = [None, "", " \n", "one", "x " * 23, "x " * 24, "\tx\n" * 25, "a b " * 11 + "a", "a b " * 11 + "a b", "a b c d e f g h " * 3, "a b c d e f g h " * 3 + "A", "A a b c d e f g h " * 3]
    out.append("p q r " * 10 + "s " * 30 + "p q r " * 9 + "p")
    out.append(("u v " * 12 + "z ") * 4)
    for _ in range(150):
        w = [rng.choice(vocabulary) for _ in range(rng.choice([5, 30, 80, 200]))]
        out.append("  ".join(w * rng.choice([1, 1, 2, 4])))
    return out


@pytest.fixture(scope="module")
def rows():
    out = [(i - 3, t, "en", 1, 2, "s") for i, t in enumerate(_texts())]
    return [*out, out[13], out[40], (None, "k l " * 20, None, None, None, None), (None, None, None, None, None, None)]


def test_query(spark, rows):
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = _got(periods.digest(periods.periodic_runs(periods.planted(df))))
    wanted = sorted((_plain(r[0], r[1]) for r in rows), key=repr)
    assert got == wanted
    assert sum(r[1] > 0 for r in wanted) > 30 and max(r[1] for r in wanted) > 2
    assert periods.digest(periods.periodic_runs(periods.planted(spark.createDataFrame([], DOCS)))).count() == 0


def test_real_output(spark):
    df = spark.createDataFrame([(1, "a b " * 20 + " end", "", 0, 0, ""), (2, "plain\n text", "", 0, 0, "")], DOCS)
    got = {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periods.periodic_runs(df).collect()}
    assert got == {1: (41, [(0, 40, 2)], "a b end"), 2: (2, [], "plain text")}


def test_whole_table(spark):
    """The registered query over a given table, every row against brute force where its texts are short enough for it."""
    sf_dir = "/root/testdata/sf0.001"
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.op12_periodic_runs(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    short = [r for r in docs if len(r.text or "") < 6000]
    assert len(short) > 100
    for r in short:
        assert got[r.doc_id] == _plain(r.doc_id, r.text)


def test_long_text():
    """A million words in bounded memory: random, one word, and a long period."""
    rng = np.random.default_rng(5)
    n = 300_000
    texts = [rng.integers(0, 50_000, n), np.zeros(n, np.int64), np.tile(rng.integers(0, 9, 90_000), 4)[:n]]
    tracemalloc.start()
    rows = periods.find_runs(np.concatenate(texts), np.arange(4) * n)
    assert tracemalloc.get_traced_memory()[1] < 1 << 30
    tracemalloc.stop()
    assert [1, 0, n, 1] in rows.tolist() and [2, 0, n, 90_000] in rows.tolist() and not (rows[:, 0] == 0).any()
