"""Periodic runs of words by the runs theorem.

A run is a stretch of consecutive words with smallest period q, long enough, that neither neighbour
extends. Every run holds a Lyndon word of length q, under one of two orders of the words (an order and
its inverse), that is the longest Lyndon word at its place; it begins at most q words after
the run does. So per place there are two candidates. The longest Lyndon word at a place ends before
the next smaller value of the inverse suffix array, which is made by prefix doubling under each
order. Candidates whose period does not go on for as many words as a run needs are put aside by the ranks of
some words; the others are extended in both directions by longest common prefixes,
least values of the LCP array between two suffixes, found in a sparse table, of the texts and of the reversed texts.

All steps are numpy operations over the words of many texts at once; texts are told apart in the
first key of the order, so no suffix is compared with one of another text. Words are numbered exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helispan.llm.arrow import bound_batches
from helispan.llm.text import slices, word_spans, words

#: Least length of a run in words, and in periods.
LENGTH = 24
EXPONENT = 3
#: Values of the LCP array for each entry of the sparse table.
BLOCK = 16

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def suffix_ranks(ids: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Ranks of the places of some texts by their first 1, 2, 4, ... words; the last table tells all apart.

    Texts are ``ids[first[t]:first[t + 1]]``. Places of later texts have lower ranks, and within a text
    one that ends comes before those that go on.
    """
    n = len(ids)
    text = np.repeat(np.arange(len(first) - 1, 0, -1), np.diff(first))
    end = np.repeat(first[1:], np.diff(first))
    key = text * (int(ids.max()) + 1 if n else 1) + ids
    rank = np.zeros(n, np.int32)
    levels: list[np.ndarray] = []
    active, step = np.arange(n), 0
    while True:
        order = np.argsort(key)
        active, key = active[order], key[order]
        place = np.arange(len(active))
        new = np.concatenate([[True], key[1:] != key[:-1]])[: len(active)]
        begin = np.maximum.accumulate(np.where(new, place, 0))
        if step:
            old = rank[active]
            group = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]])[: len(active)], place, 0))
            rank = rank.copy()
            rank[active] = old + (begin - group)
        else:
            rank[active] = begin
        levels.append(rank)
        alone = new & np.concatenate([new[1:], [True]])[: len(active)]
        active = active[~alone]
        if not len(active):
            return levels
        step = 1 << len(levels) - 1
        after = active + step
        key = rank[active].astype(np.int64) * (n + 1) + np.where(after < end[active], rank[np.minimum(after, n - 1)] + 1, 0)


def next_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller value, or the length; least values of blocks of 1, 2, 4, ... lead there."""
    n = len(values)
    least = [np.append(values, -1)]
    place = np.arange(1, n + 1)
    level = np.zeros(n, np.int8)
    active = np.arange(n)
    while True:
        k = len(least) - 1
        active = active[least[k][place[active]] > values[active]]
        if not len(active):
            break
        place[active] = np.minimum(place[active] + (1 << k), n)
        level[active] = k + 1
        m = least[k]
        least.append(np.minimum(m, m[np.minimum(np.arange(n + 1) + (1 << k), n)]))
    for k in range(len(least) - 2, -1, -1):
        active = np.flatnonzero(level > k)
        onward = active[least[k][place[active]] > values[active]]
        place[onward] = np.minimum(place[onward] + (1 << k), n)
    return place


class Extensions:
    """Longest common prefixes of any two places of a text: LCP array and a sparse table over blocks of it."""

    def __init__(self, ids: np.ndarray, first: np.ndarray) -> None:
        levels = suffix_ranks(ids, first)
        self.rank = levels[-1]
        n = len(ids)
        order = np.empty(n, np.int64)
        order[self.rank] = np.arange(n)
        a, b = order[:-1], order[1:]
        known = np.zeros(max(n - 1, 0), np.int8)
        active = np.arange(len(a))
        for k, rank in enumerate(levels):
            active = active[rank[a[active]] == rank[b[active]]]
            known[active] = k + 1
        length = np.where(known > 0, 1 << np.maximum(known.astype(np.int64) - 1, 0), 0)
        for k in range(len(levels) - 2, -1, -1):
            active = np.flatnonzero(known > k + 1)
            x, y = a[active] + length[active], b[active] + length[active]
            inside = (x < n) & (y < n)
            equal = levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)]
            length[active[inside & equal]] += 1 << k
        del levels
        #: lcp[r]: words in common of the suffixes of ranks r - 1 and r.
        self.lcp = np.concatenate([[0], length]).astype(np.int32)[: max(n, 1)]
        padded = np.pad(self.lcp, (0, -len(self.lcp) % BLOCK)).reshape(-1, BLOCK)
        self.table = [padded.min(axis=1)]
        while (1 << len(self.table)) <= len(padded):
            m, half = self.table[-1], 1 << len(self.table) - 1
            self.table.append(np.minimum(m[:-half], m[half:]))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words in common from the different places ``a`` and ``b`` on."""
        x, y = self.rank[a].astype(np.int64), self.rank[b].astype(np.int64)
        low, high = np.minimum(x, y) + 1, np.maximum(x, y) + 1
        out = np.full(len(a), np.iinfo(np.int32).max, np.int64)
        for k in range(BLOCK):
            for place in (low + k, high - 1 - k):
                out = np.where((place >= low) & (place < high), np.minimum(out, self.lcp[np.clip(place, 0, len(self.lcp) - 1)]), out)
        begin, stop = -(-low // BLOCK), high // BLOCK
        wide = np.flatnonzero(stop > begin)
        level = np.frexp((stop - begin)[wide].astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            own = wide[level == k]
            m = self.table[k]
            out[own] = np.minimum(out[own], np.minimum(m[begin[own]], m[stop[own] - (1 << k)]))
        return out


def _candidates(ids: np.ndarray, first: np.ndarray, length: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and lengths of longest Lyndon words under both orders whose length is the period of enough words."""
    end = np.repeat(first[1:], np.diff(first))
    place = np.arange(len(ids))
    found = []
    for own in (ids, ids.max() - ids):
        levels = suffix_ranks(own, first)
        q = next_smaller(levels[-1]) - place
        # A run goes on for so many words after the first such word of it.
        more = np.maximum(length - 2 * q, (exponent - 2) * q)
        some = np.flatnonzero((place + q + more <= end) & (place + q < end))
        known = max(1, min(max(length - 2 * x, (exponent - 2) * x) for x in range(1, length)))
        k = known.bit_length() - 1
        if k < len(levels):
            some = some[levels[k][some] == levels[k][some + q[some]]]
        else:
            some = some[:0]
        found.append(np.stack([some, q[some]]))
    return tuple(np.concatenate(found, axis=1))


def find_runs(ids: np.ndarray, first: np.ndarray, length: int = LENGTH, exponent: int = EXPONENT) -> np.ndarray:
    """Rows of text, start, length and period of the runs of some texts, in this order, sorted by text, start and period."""
    none = np.zeros((0, 4), np.int64)
    if not len(ids):
        return none
    at, q = _candidates(ids, first, length, exponent)
    if not len(at):
        return none
    # The texts with candidates, put together, and reversed as a whole.
    text = np.searchsorted(first, at, side="right") - 1
    kept, number = np.unique(text, return_inverse=True)
    size = np.diff(first)[kept]
    base = np.concatenate([[0], np.cumsum(size)])
    own = ids[np.repeat(first[kept] - base[:-1], size) + np.arange(base[-1])]
    at = at - first[kept][number] + base[number]
    more = Extensions(own, base).common(at, at + q)
    enough = np.flatnonzero(more >= np.maximum(length - 2 * q, (exponent - 2) * q))
    at, q, more, number = at[enough], q[enough], more[enough], number[enough]
    n = len(own)
    back = Extensions(own[::-1], n - base[::-1])
    before = np.zeros(len(at), np.int64)
    inner = np.flatnonzero(at > base[number])
    before[inner] = back.common(n - at[inner], n - at[inner] - q[inner])
    start, total = at - before, before + q + more
    good = np.flatnonzero((total >= length) & (total >= exponent * q))
    rows = np.stack([kept[number[good]], start[good] - base[number[good]], total[good], q[good]], axis=1)
    return np.unique(rows[:, [0, 1, 3, 2]], axis=0)[:, [0, 1, 3, 2]] if len(rows) else none


def numbered_words(off: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the words of some rows, the first word of each row, the rows with one space between words, and their offsets."""
    start, end, first = word_spans(off, raw)
    size = end - start
    keep = np.zeros(len(raw) + 1, bool)
    mark = np.zeros(len(raw) + 1, np.int8)
    mark[start] += 1
    mark[end] -= 1
    inside = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
    data = np.ascontiguousarray(raw[inside])
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    ids = array.dictionary_encode().indices.to_numpy().astype(np.int64)
    later = np.ones(len(start), bool)
    later[first[:-1][first[:-1] < first[1:]]] = False
    spaced = raw.copy()
    spaced[start[later] - 1] = 0x20
    keep[:-1] = inside
    keep[start[later] - 1] = True
    at = np.concatenate([[0], np.cumsum(keep[:-1])])[off]
    return ids, first, spaced[keep[:-1]], at


def _collapsed(words_of: list[bytes], runs: np.ndarray) -> bytes:
    """Words joined by one space, without those that a run repeats after its first period."""
    change = np.zeros(len(words_of) + 1, np.int64)
    np.add.at(change, runs[:, 1] + runs[:, 3], 1)
    np.add.at(change, runs[:, 1] + runs[:, 2], -1)
    dropped = np.cumsum(change[:-1]) > 0
    return b" ".join(w for w, d in zip(words_of, dropped.tolist(), strict=True) if not d)


def periodic_runs(docs: DataFrame, length: int = LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """Per document: doc_id, n_words, runs (by start, then period) and collapsed.

    A run has at least ``length`` words and ``exponent`` (2 or more) periods. ``collapsed`` is the words joined by one
    space, without those that a run holds after its first period. Null and empty texts have no word, no run and
    an empty ``collapsed``; repeated rows repeat, null ids stay null, other columns are ignored. Nothing is
    shuffled; memory grows with the batch, or with one text where that is longer.
    """
    if length < 2 or exponent < 2:
        raise ValueError("runs have two words and two periods at least")
    bound_batches(docs.sparkSession)
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, off, raw in slices(batch.column(1)):
                ids, first, flat, at = numbered_words(off, raw)
                runs = find_runs(ids, first, length, exponent)
                n = len(off) - 1
                begins = np.searchsorted(runs[:, 0], np.arange(n + 1))
                texts = [flat[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                for t in np.unique(runs[:, 0]).tolist():
                    texts[t] = _collapsed(texts[t].split(b" "), runs[begins[t] : begins[t + 1]])
                spans = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(runs[:, k])) for k in (1, 2, 3)], fields=list(run))
                listed = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), spans)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.array(np.diff(first)), listed, pa.array(texts, pa.binary()).view(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(rows, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` in which a tenth of the documents, told by crc32 of their ids, go on in a period.

    In these each word from a place on is the word of the period's first turn; words are joined by one space. Others, and those
    without id or words, stay as they are.
    """
    w, h = words("text"), F.crc32(F.col("doc_id").cast("string"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", h.alias("h"))
    own = own.withColumn("w", F.when(F.col("h") % 10 == 0, w)).withColumn("g", F.floor(F.col("h") / 10)).withColumn("n", F.size("w"))
    own = own.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    own = own.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    tail = F.transform(F.sequence("a", F.col("n") - 1), lambda i: F.get("w", F.col("a") + (i - F.col("a")) % F.col("p")))
    text = F.when(F.col("a").isNotNull(), F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")).otherwise(F.col("text"))
    return own.select("doc_id", text.alias("text"))


def _sha(text: Column) -> Column:
    return F.sha2(text, 256)


def digest(found: DataFrame) -> DataFrame:
    """Per document: number of runs, the run of greatest exponent, checksums of all runs and of the collapsed text."""

    def better(a: Column, b: Column) -> Column:
        # Runs come by start and period, so that the first one stays where exponents are equal.
        return F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)

    best = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    chosen = found.withColumn("best", best)
    return chosen.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        _sha(F.array_join(lines, "")).alias("runs_sha256"),
        _sha(F.col("collapsed")).alias("collapsed_sha256"),
    )
