"""The near-duplicate stage of the pipeline, with its own shingles and threshold."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from tests.llm import brute


def _shingles(text, k):
    w = brute.WORD.findall((text or "").translate(brute.FOLD))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def _components(rows, k, percent):
    sets = [_shingles(t, k) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return brute.components(range(len(rows)), links)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(150)]
    texts = ["", "one", "one two three four", "One two  three FOUR", "one two three four five"]
    for n in [5, 8, 20, 45, 46, 60, 90, 100, 200, 400, 800] * 2:
        t = [rng.choice(vocabulary) for _ in range(n)]
        texts.append(" ".join(t))
        for edits in (1, 2, 3, n // 50, n // 45, n // 40):
            w = list(t)
            for _ in range(edits):
                w[rng.randrange(n)] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    return list(enumerate(texts))


def test_stage_against_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    of = _components(rows, 5, 80)
    got = sorted(r.doc_id for r in corpus_pipeline.jaccard_join(spark, docs, "").collect())
    assert got == [i for i, _ in rows if of[i] == i]
    tight = _components(rows, 3, 90)
    assert len(got) < sum(tight[i] == i for i, _ in rows)
