"""Toxicity by weak supervision.

All words, and beginnings of words, over-represented in toxic documents of the labelled sample are the lexicon. Voters for
the number of them in a text (1, 2, 3, 4, more) stand beside voters for patterns. A generative label model treats the voters as noisy observations of the true label:
expectation-maximisation over the counts of all vote combinations in the whole corpus estimates how
often each voter fires on either class, and the voters' correlations within a class discount the say
of those that fire together. A linear classifier over all lexicon words, their number and the patterns is then fitted to
the model's posterior labels of the sample.

Labels of documents whose ``crc32(doc_id) % 4`` is 2 are held out. Inputs of a score come from the
text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helispan.llm.arrow import bound_batches
from helispan.llm.text import TERMS, hashed_words, slices

HELD_OUT = 2
THRESHOLD = 0.3
#: Bound of the labelled sample: the rows of least hash of their id.
MAX_LABELLED = 20_000
#: Lexicon voters: each fires at one number of lexicon words, the last at that and above.
LEXICON_VOTERS = 5
#: A word needs so many toxic documents (or that share of them) and that precision.
MIN_TOXIC, MIN_SHARE, MIN_PRECISION = 5, 0.01, 0.8
#: Beginnings of words, in bytes, that are candidates beside whole words.
PREFIXES = (4, 5, 6, 7, 8)
PATTERNS = 3
ROUNDS = 30
#: Weight of the labels of the sample in the estimates, in documents of the corpus for each.
ANCHOR = 1.0
RIDGE = 0.1


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == HELD_OUT


def _documents(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, list[np.ndarray]]]:
    """Batch, row, pattern votes and hashed words of each text, row by row in runs."""
    for batch in batches:
        for at, off, raw in slices(batch.column(column)):
            h, first = hashed_words(off, raw, TERMS, PREFIXES)
            upper = np.add.reduceat(np.concatenate([(raw >= 65) & (raw <= 90), [False]]).astype(np.int64), off[:-1]) * (np.diff(off) > 0)
            letter = np.add.reduceat(np.concatenate([(raw >= 97) & (raw <= 122), [False]]).astype(np.int64), off[:-1]) * (np.diff(off) > 0)
            loud = np.add.reduceat(np.concatenate([(raw[:-1] == 33) & (raw[1:] == 33), [False, False]])[: len(raw) + 1].astype(np.int64), off[:-1]) * (np.diff(off) > 0) if len(raw) else np.zeros(len(off) - 1, np.int64)
            symbol = np.add.reduceat(np.concatenate([np.isin(raw, list(b"#*$%&@")), [False]]).astype(np.int64), off[:-1]) * (np.diff(off) > 0)
            shapes = np.stack([upper > letter, loud > 0, symbol * 20 > np.diff(off)], axis=1)
            yield batch, at, shapes, [h[a:b].reshape(-1) for a, b in zip(first[:-1], first[1:], strict=True)]


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``toxic, text`` of at most MAX_LABELLED labelled documents that are not held out, one row each.

    A document with both labels is toxic; of several texts under one id the least is taken.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    rows = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(rows), "doc_id")
    return found.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text")).select("toxic", "text")


def _candidates(sample: DataFrame) -> np.ndarray:
    """Hashes of the words and beginnings of words whose share of toxic documents is most certainly above their share of others."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, _, terms in _documents(batches, 1):
            toxic = batch.column(0).slice(at, len(terms)).to_numpy()
            for label in (0, 1):
                mine = [np.unique(t) for t, y in zip(terms, toxic, strict=True) if y == label]
                if mine:
                    term, n = np.unique(np.concatenate(mine), return_counts=True)
                    term, n = term[term != 0], n[term != 0]
                    yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n * (label == 1)), pa.array(n * (label == 0))], names=["term", "bad", "good"])

    total = sample.groupBy("toxic").count().collect()
    size = {r["toxic"]: r["count"] for r in total}
    if not size.get(1):
        return np.zeros(0, np.uint64)
    each = sample.mapInArrow(counts, "term long, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    precision = (F.col("bad") + 0.5) / (F.col("bad") + F.col("good") + 1)
    found = each.where((F.col("bad") >= max(MIN_TOXIC, MIN_SHARE * size[1])) & (precision >= MIN_PRECISION))
    rows = found.orderBy(F.desc(F.col("bad") * precision**3), "term").collect()
    return np.array([r["term"] for r in rows], dtype=np.int64).view(np.uint64)


def _presence(sample: DataFrame, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels, candidate words present and pattern votes of the sample, which is bounded."""
    order = np.argsort(candidates)
    known = candidates[order]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, shapes, terms in _documents(batches, 1):
            bits = np.zeros((len(terms), len(known)), dtype=bool)
            for i, t in enumerate(terms):
                bits[i, order[np.isin(known, t)]] = True
            packed = [b.tobytes() for b in np.packbits(bits, axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(terms)), pa.array(packed, pa.binary()), pa.array([s.tobytes() for s in shapes], pa.binary())], names=["toxic", "words", "shapes"])

    got = sample.mapInArrow(rows, "toxic int, words binary, shapes binary").collect()
    y = np.array([r["toxic"] for r in got], dtype=float)
    bits = np.stack([np.unpackbits(np.frombuffer(bytes(r["words"]), np.uint8), count=len(known)) for r in got]).astype(bool)
    return y, bits, np.stack([np.frombuffer(bytes(r["shapes"]), bool) for r in got])


def _votes(present: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """Votes of all voters: numbers of lexicon words, one voter for each, and the patterns."""
    n = np.minimum(present.sum(axis=1), LEXICON_VOTERS)[:, None]
    return np.concatenate([n == np.arange(1, LEXICON_VOTERS + 1), shapes], axis=1)


VOTERS = LEXICON_VOTERS + PATTERNS
_BITS = 1 << np.arange(VOTERS)


def fit_label_model(combos: np.ndarray, counts: np.ndarray, votes: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Posterior of the toxic label for every combination of votes (a bit for each voter).

    ``combos`` and ``counts`` are the combinations in the corpus; ``votes`` and ``y`` the labelled
    sample, which starts and anchors the estimates. A voter that does not fire abstains, and no lexicon
    voter firing is an event of its own. Voters that fire together share their say as far as they are
    correlated within a class.
    """
    def events(v: np.ndarray) -> np.ndarray:
        return np.concatenate([v, ~v[:, :LEXICON_VOTERS].any(axis=1)[:, None]], axis=1).astype(float)

    x, labelled = events(combos[:, None] & _BITS > 0), events(votes)
    seen = [labelled[y == c].sum(axis=0) * ANCHOR for c in (0, 1)]
    size = [(y == c).sum() * ANCHOR for c in (0, 1)]
    fire = np.stack([(s + 0.05) / (n + 0.1) for s, n in zip(seen, size, strict=True)])
    prior = np.clip(size[1] / sum(size), 1e-4, 1 - 1e-4)
    shared = np.zeros((VOTERS + 1, VOTERS + 1))

    def posterior(v: np.ndarray) -> np.ndarray:
        say = np.log(np.clip(fire[1], 1e-6, 1) / np.clip(fire[0], 1e-6, 1))
        gain = (v / (1 + v @ shared) * say).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + gain, -40, 40)))

    for _ in range(ROUNDS):
        p = posterior(x)
        weight = [counts * (1 - p), counts * p]
        shared = np.zeros_like(shared)
        for c in (0, 1):
            total = weight[c].sum() + size[c]
            fire[c] = (weight[c] @ x + seen[c] + 0.05) / (total + 0.1)
            off = x - fire[c]
            spread = np.sqrt(np.maximum((off**2 * weight[c][:, None]).sum(axis=0), 1e-9))
            shared = np.maximum(shared, (off * weight[c][:, None]).T @ off / np.outer(spread, spread))
        np.fill_diagonal(shared, 0)
        prior = np.clip((weight[1].sum() + size[1]) / (counts.sum() + sum(size)), 1e-4, 1 - 1e-4)
    return posterior(events(np.arange(1 << VOTERS)[:, None] & _BITS > 0))


def _fit_linear(x: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression on soft labels, the last for the constant, by Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1).astype(float)
    ridge = np.full(x.shape[1], RIDGE)
    ridge[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (target - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _features(present: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """Each lexicon word, their number up to 1, 2, 3 and 4, and the patterns."""
    return np.concatenate([present, np.minimum(present.sum(axis=1)[:, None], np.arange(1, LEXICON_VOTERS)), shapes], axis=1)


def _present(terms: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    out = np.zeros((len(terms), len(words)), dtype=bool)
    if len(words) and terms:
        order = np.argsort(words)
        known = words[order]
        flat = np.concatenate(terms)
        at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
        hit = np.flatnonzero(known[at] == flat)
        owner = np.searchsorted(np.cumsum([len(t) for t in terms]), hit, side="right")
        out[owner, order[at[hit]]] = True
    return out


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lexicon and the weights of the classifier.

    Without toxic labels the lexicon is empty, and with no labels at all the score is near 0 for all.
    """
    sample = _sample(docs, labels)
    words = _candidates(sample)
    if not len(words):
        return words, np.array([0.0] * (LEXICON_VOTERS - 1 + PATTERNS) + [-5.0])
    y, present, shapes = _presence(sample, words)

    def combos(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, shapes, terms in _documents(batches, 0):
            combo, n = np.unique(_votes(_present(terms, words), shapes) @ _BITS, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(combo, pa.int64()), pa.array(n, pa.int64())], names=["combo", "n"])

    # At most 2 ** VOTERS rows.
    rows = docs.select("text").mapInArrow(combos, "combo long, n long").groupBy("combo").agg(F.sum("n").alias("n")).collect()
    votes = _votes(present, shapes)
    posterior = fit_label_model(np.array([r["combo"] for r in rows]), np.array([r["n"] for r in rows], float), votes, y)
    return words, _fit_linear(_features(present, shapes), posterior[votes @ _BITS])


def score(docs: DataFrame, words: np.ndarray, weights: np.ndarray) -> DataFrame:
    """``doc_id, score`` per document, from the whole text; a null or empty text gets a score as well."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, shapes, terms in _documents(batches, 1):
            x = _features(_present(terms, words), shapes)
            p = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(terms)), pa.array(p)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 from a score of THRESHOLD on).

    A null ``doc_id`` is not held out; repeated rows repeat; other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    scored = score(docs, *train(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
