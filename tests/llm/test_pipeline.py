"""The whole pipeline against brute force, and on tables with nothing in them."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from helispan.llm import mixing, quality, tokens
from helispan.session import shared_path
from tests.llm import brute
from tests.llm.test_stages import _components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sid long, n_words int, copies string, secrets string"


def _documents():
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    texts = [None, "", "too short", "again and again and " * 20]
    for i in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.choice([25, 60, 130, 700]))]
        texts.append(" ".join(w))
        if i % 3 == 0:
            w[rng.randrange(len(w))] = "other"
            texts.append(" ".join(w))
        if i % 7 == 0:
            texts.append(" ".join([*w, "token=abcdefghijkl123 é q8Zr2LxV0tPw7YbN4mKc9sHd", *rng.choices(vocabulary, k=40)]))
        if i == 5:
            texts.append(" ".join("#$%&|<>*"[rng.randrange(8)] * rng.randint(1, 6) for _ in range(90)))
    rows = [(i, t, "en" if i % 9 else None, ["a", "b", None, "ä"][i % 4], None if t is None else len(t), i, 1, "x", None) for i, t in enumerate(texts)]
    return [*rows, (None, *rows[10][1:]), (None, None, None, None, None, None, None, None, None), rows[12]]


def _kept(rows):
    """Rows that pass the quality rules; the distances from histograms counted one by one."""
    facts = []
    for r in rows:
        t, w = r[1] or "", brute.WORD.findall(r[1] or "")
        left, counts = t, []
        for test in (str.islower, None, str.isupper, str.isdecimal, None, None):
            i = len(counts)
            pattern = {1: r"[\x20\x09-\x0D]", 4: r"[#*$%&|<>]", 5: r"[.,;:!?'\"()-]"}.get(i)
            hit = [bool(re.match(pattern, c)) if pattern else test(c) for c in left]
            counts.append(sum(hit))
            left = "".join(c for c, h in zip(left, hit) if not h)
        counts.append(len(left))
        common = Counter(x for x in w if x in quality.VOCABULARY)
        v = [common[x] for x in quality.VOCABULARY]
        p = np.array(counts) / len(t) if t else np.zeros(7)
        q = np.array([*v, len(w) - sum(v)]) / len(w) if w else np.zeros(len(v) + 1)
        facts.append((len(w), brute.quality(t)[5], p, q))
    means = {}
    for lang in {r[2] for r in rows}:
        own = [f for r, f in zip(rows, facts) if r[2] == lang and f[0] >= 50 and not f[1]]
        if len(own) >= 20:
            means[lang] = [np.mean([f[k] for f in own], axis=0) for k in (2, 3)]

    def distance(a, b):
        m = (a + b) / 2
        part = lambda x: np.sum(x[x > 0] * np.log2(x[x > 0] / m[x > 0]))
        return np.sqrt(max((part(a) + part(b)) / 2, 0))

    out = []
    for r, (n, failed, p, q) in zip(rows, facts):
        odd = n >= 50 and r[2] in means and (distance(p, means[r[2]][0]) > quality.MAX_CLASS_DISTANCE or distance(q, means[r[2]][1]) > quality.MAX_WORD_DISTANCE)
        if not failed and not odd:
            out.append(r)
    return out


def _masked(text):
    spans = sorted((int(a), int(b)) for x in brute.all_spans(text).split(",") if x for _, a, b in [x.split(":")])
    out, at = "", 0
    for a, b in spans:
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def _written(spark, rows):
    path = shared_path(spark, "input")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def test_run_against_brute_force(spark):
    rows = _documents()
    kept = _kept(rows)
    assert len(rows) - len(kept) >= 5
    of = _components([(i, r[1]) for i, r in enumerate(kept)], 5, 80)
    best = {}
    for i, r in enumerate(kept):
        key = (r[0] is None, r[0] or 0)
        if of[i] not in best or key < best[of[i]][0]:
            best[of[i]] = (key, r)
    single = [(*r[:1], _masked(r[1]), *r[2:]) for _, r in best.values()]
    assert any("[SECRET]" in r[1] for r in single)
    taken = Counter({r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(single, SCHEMA)).collect()})
    encode, wanted = Tokenizer.from_file(tokens.BYTE_BPE), Counter()
    for r in single:
        ids = np.array([*encode.encode(r[1], add_special_tokens=False).ids, 0], "<u4")
        at = 0
        while at < len(ids):
            n = min(1024, 1 << (len(ids) - at).bit_length() - 1)
            wanted[r[0], at, n, len(ids), zlib.crc32(ids[at : at + n].tobytes())] += taken[r[0]]
            at += n
    got = Counter((r.doc_id, r.start, r.length, r.doc_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, _written(spark, rows)).collect())
    assert got == +wanted


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None, None, None, None, None)] * 3])
def test_run_on_nothing(spark, rows):
    assert corpus_pipeline.run(spark, _written(spark, rows)).count() == 0


def test_stages_keep_columns(spark):
    docs = spark.createDataFrame(_documents(), SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").schema.simpleString() == docs.schema.simpleString()
