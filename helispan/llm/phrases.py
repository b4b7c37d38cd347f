"""Phrase collocations from depth-limited count tries.

Every place of a word gives a path: the language, then the word and up to three words after it within
its piece. A shard is about SHARD words; its trie is the sorted distinct paths with counts, and
the count of an inner node is that of the paths below it. Tries are cut at the borders of prefix ranges and
sent front-coded: a path holds only the words by which it differs from the path before. The borders, which only decide
how even ranges of about RANGE_WORDS places are, come from a bounded sample of the documents. A task merges
the sorted pieces of a range. It walks the merged trie and emits the nodes that are frequent, and those on
the paths at the edges of the range, which may go on in the next; their counts are added up after.

A phrase's first part is found by walking up the trie, the rest by its suffix link, the node without the first word.
Both are joins of a level of nodes with the level above, which passes on what it has found: all first
parts of a phrase are its parent and the parent's first parts, and all rests its link and the link's rests.
A part of a frequent phrase is frequent itself, so frequent nodes suffice, and no others are counted out.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helispan.llm.arrow import bound_batches, runs
from helispan.llm.lookup import lookup
from helispan.llm.text import byte_table, slices, word_spans
from helispan.session import finished, materialize

DEPTH = 4
MIN_COUNT = 30
#: Part of a phrase's occurrences, in hundredths, that a longer phrase holds so that the shorter one is dropped.
WITHIN = 80
TOP = 2000
SCALE = 2_000_000
UNKNOWN = "und"

SHARD = 1 << 19
RANGE_WORDS = 1 << 19
#: Tasks that the ranges are dealt to at most.
MERGE_TASKS = 10_000
#: Documents whose paths offer borders: one of so many, but within these bounds, and one path of so many of a trie.
SAMPLE_PART, SAMPLE_LEAST, SAMPLE_MOST = 500, 20_000, 2_000_000
STRIDE = 256
#: Pieces in a batch.
PIECES = 64
#: Bytes of a word that a border keeps; borders need not be words.
BORDER_BYTES = 32
#: Parts in which a language's phrases are ranked before the best of all parts are.
RANK_PARTS = 64

BREAKS = b".,;:!?" + bytes(range(0x0A, 0x0E))
_WORDS = byte_table(BREAKS + b"\x20\x09", fold=False)
_HEAD = struct.Struct("<IIIBB")


def path_keys(paths: np.ndarray) -> np.ndarray:
    """One number for each row that orders rows as their columns do; columns hold whole numbers from -1."""
    key = np.zeros(len(paths), np.int64)
    top = 1
    for column in paths.T:
        size = int(column.max()) + 2 if len(column) else 1
        if top * size >= 1 << 62:
            distinct, key = np.unique(key, return_inverse=True)
            top = len(distinct)
        key = key * size + (column + 1)
        top *= size
    return key


def pack(words: pa.LargeBinaryArray, paths: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted distinct paths of word numbers, -1 beyond their ends, and counts as bytes."""
    size = (paths >= 0).sum(axis=1).astype(np.uint8)
    same = np.zeros(len(paths), np.uint8)
    same[1:] = np.logical_and.accumulate(paths[1:] == paths[:-1], axis=1).sum(axis=1)
    column = np.arange(paths.shape[1])
    own = (column >= same[:, None]) & (column < size[:, None])
    tails = pc.take(words, pa.array(paths[own]))
    offsets = np.frombuffer(tails.buffers()[1], np.int64)[tails.offset : tails.offset + len(tails) + 1]
    length = np.diff(offsets)
    kinds = [np.min_scalar_type(int(x.max())) for x in (length, counts)]
    data = tails.buffers()[2]
    letters = memoryview(data)[offsets[0] : offsets[-1]] if data is not None else b""
    parts = [_HEAD.pack(len(paths), len(length), len(letters), kinds[0].itemsize, kinds[1].itemsize), same, size, length.astype(kinds[0]), counts.astype(kinds[1]), letters]
    whole = b"".join(bytes(p) if isinstance(p, (bytes, memoryview)) else p.tobytes() for p in parts)
    return struct.pack("<Q", len(whole)) + pa.compress(whole, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    (n,) = struct.unpack_from("<Q", blob)
    whole = pa.decompress(memoryview(blob)[8:], decompressed_size=n, codec="zstd")
    rows, tails, letters, of_length, of_count = _HEAD.unpack_from(whole)
    at, out = _HEAD.size, []
    for kind, count in ((np.uint8, rows), (np.uint8, rows), (np.dtype(f"u{of_length}"), tails), (np.dtype(f"u{of_count}"), rows), (np.uint8, letters)):
        out.append(np.frombuffer(whole, kind, count, at))
        at += out[-1].nbytes
    return tuple(out)


def numbered(length: np.ndarray, letters: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """Distinct words in the order of their bytes, and each word's number; words are given by lengths and bytes."""
    offsets = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length, out=offsets[1:])
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters))]).dictionary_encode()
    order = pc.sort_indices(found.dictionary).to_numpy()
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    return found.dictionary.take(pa.array(order)), place[found.indices.to_numpy()]


def _added(paths: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct paths and the sums of their counts. The sort is one that merges sorted runs."""
    key = path_keys(paths)
    order = np.argsort(key, kind="stable")
    key = key[order]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    return paths[order[begin]], np.add.reduceat(counts[order], begin) if len(begin) else counts[:0]


def merge(blobs: list[bytes]) -> tuple[pa.LargeBinaryArray, np.ndarray, np.ndarray]:
    """Words, paths and counts of the trie that holds all paths of some packed ones."""
    same, size, length, counts, letters = (np.concatenate(c) for c in zip(*map(_unpack, blobs), strict=True))
    words, number = numbered(length, letters)
    del length, letters
    column = np.arange(DEPTH + 1)
    paths = np.full((len(same), DEPTH + 1), -1, np.int32)
    paths[(column >= same[:, None]) & (column < size[:, None])] = number
    del number
    row = np.arange(len(same), dtype=np.int32)
    for c in column:
        paths[:, c] = paths[np.maximum.accumulate(np.where(same <= c, row, 0)), c]
    return (words, *_added(paths, counts.astype(np.int64)))


class _Shard:
    """Words of texts until there are enough for a trie."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.languages: dict[str, int] = {}
        self.size = 0

    def add(self, off: np.ndarray, raw: np.ndarray, languages: list[str]) -> None:
        start, end, first = word_spans(off, raw, _WORDS)
        breaks = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(np.isin(raw, np.frombuffer(BREAKS, np.uint8)), out=breaks[1:])
        opens = np.zeros(len(start), bool)
        opens[1:] = breaks[start[1:]] != breaks[end[:-1]]
        opens[first[:-1][first[:-1] < len(start)]] = True
        letters = raw[_WORDS[raw] != 0]
        letters = np.where((letters >= 65) & (letters <= 90), letters + np.uint8(32), letters)
        of = [self.languages.setdefault(x, len(self.languages)) for x in languages]
        self.held.append((end - start, letters, opens, np.repeat(np.array(of, np.int64), np.diff(first))))
        self.size += len(start)

    def tries(self) -> Iterator[tuple[pa.LargeBinaryArray, np.ndarray, np.ndarray]]:
        """The tries of the words held, which are forgotten."""
        length, letters, opens, language = (np.concatenate(c) for c in zip(*self.held, strict=True))
        names = [x.encode() for x in self.languages]
        length = np.concatenate([[len(x) for x in names], length])
        letters = np.concatenate([np.frombuffer(b"".join(names), np.uint8), letters])
        words, number = numbered(length, letters)
        language, number = number[: len(names)][language], number[len(names) :]
        self.__init__()
        n = len(number)
        cuts = np.append(np.flatnonzero(opens), n)
        stop = np.repeat(cuts[1:], np.diff(cuts))
        for a in range(0, n, SHARD):
            place = np.arange(a, min(a + SHARD, n))
            paths = np.full((len(place), DEPTH + 1), -1, np.int32)
            paths[:, 0] = language[place]
            for d in range(DEPTH):
                at = place + d
                paths[:, d + 1] = np.where(at < stop[place], number[np.minimum(at, n - 1)], -1)
            yield (words, *_added(paths, np.ones(len(place), np.int64)))


def _sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.LargeBinaryArray, np.ndarray, np.ndarray]]:
    """The tries of all shards of a task's rows of text and language."""
    shard = _Shard()
    for batch in batches:
        languages = batch.column(1).to_pylist()
        for at, off, raw in slices(batch.column(0)):
            shard.add(off, raw, languages[at : at + len(off) - 1])
            if shard.size >= SHARD:
                yield from shard.tries()
    if shard.size:
        yield from shard.tries()


def _borders(docs: DataFrame) -> list[tuple[bytes, ...]]:
    """Words of the borders between prefix ranges, at most some millions of short texts, whatever the input."""
    n = docs.count()
    share = min(1.0, max(SAMPLE_LEAST, min(SAMPLE_MOST, n // SAMPLE_PART)) / max(n, 1))

    def offers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, paths, counts in _sharded(batches):
            offered = [b" ".join(words[i].as_py()[:BORDER_BYTES] for i in p if i >= 0) for p in paths[min(STRIDE, len(paths)) // 2 :: STRIDE].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([int(counts.sum())], pa.int64()), pa.array([offered], pa.list_(pa.binary()))], names=["words", "offered"])

    some = (docs.sample(share, seed=1) if share < 1 else docs).mapInArrow(offers, "words long, offered array<binary>").collect()
    ranges = int(-(-sum(r["words"] for r in some) / share // RANGE_WORDS))
    found = sorted({tuple(bytes(b).split(b" ")[: DEPTH + 1]) for r in some for b in r["offered"]})
    return [found[len(found) * k // ranges] for k in range(1, ranges)] if len(found) > ranges else found


def cut(words: pa.LargeBinaryArray, paths: np.ndarray, parts: list[tuple[bytes, ...]]) -> np.ndarray:
    """How many of the sorted paths come before each of some borders, given by their words."""
    asked = sorted({w for p in parts for w in p})
    # Numbers twice as large leave room for words that the trie lacks.
    both, number = numbered(np.array([len(w) for w in [*asked, *words.to_pylist()]]), np.frombuffer(b"".join([*asked, *words.to_pylist()]), np.uint8))
    code = dict(zip(asked, number[: len(asked)].tolist(), strict=True))
    rows = np.full((len(parts), DEPTH + 1), -1, np.int64)
    for row, part in zip(rows, parts, strict=True):
        row[: len(part)] = [code[w] for w in part]
    own = np.append(number[len(asked) :], np.int32(-1))[paths]
    key = path_keys(np.concatenate([own, rows]))
    return np.searchsorted(key[: len(paths)], key[len(paths) :])


def _pieces(docs: DataFrame, borders: list[tuple[bytes, ...]]) -> DataFrame:
    """``range, blob``: the pieces of all tries between the borders."""
    shared = docs.sparkSession.sparkContext.broadcast(borders)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, paths, counts in _sharded(batches):
            ends = [0, *(cut(words, paths, shared.value).tolist() if shared.value else []), len(paths)]
            some = [(k, a, b) for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if b > a]
            for at in range(0, len(some), PIECES):
                own = some[at : at + PIECES]
                packed = [pack(words, paths[a:b], counts[a:b]) for _, a, b in own]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in own], pa.int32()), pa.array(packed, pa.binary())], names=["range", "blob"])

    return docs.mapInArrow(rows, "range int, blob binary")


def walk(words: pa.LargeBinaryArray, paths: np.ndarray, counts: np.ndarray, least: int) -> Iterator[tuple[int, pa.Array, pa.Array, np.ndarray]]:
    """Depth, languages, phrases and counts of the nodes at each depth: frequent ones, those at the edges, and all languages."""
    new = np.zeros(len(paths), bool)
    new[:1] = True
    for depth in range(DEPTH + 1):
        new[1:] |= paths[1:, depth] != paths[:-1, depth]
        begin = np.flatnonzero(new)
        total = np.add.reduceat(counts, begin)
        kept = (total >= least) | (depth == 0)
        kept[[0, -1]] = True
        kept &= paths[begin, depth] >= 0
        at = begin[kept]
        parts = [pc.take(words, pa.array(paths[at, c])) for c in range(depth + 1)]
        phrase = pc.binary_join_element_wise(*parts[1:], pa.scalar(b" ", pa.large_binary())) if depth > 1 else parts[-1]
        yield depth, parts[0], phrase, total[kept]


def frequent_nodes(docs: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    """``lang, depth, phrase, f``: phrases of 1 to 4 words that occur ``least`` times or more, and each language's words at depth 0."""
    bound_batches(docs.sparkSession)
    own = docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"))
    borders = _borders(own)
    pieces = _pieces(own, borders).repartition(min(len(borders) + 1, MERGE_TASKS), "range").sortWithinPartitions("range")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for of in runs(batches, 0):
            blobs = of.column(1).to_pylist()
            del of
            for depth, language, phrase, total in walk(*merge(blobs), least):
                columns = [language.cast(pa.binary()).view(pa.string()), pa.array(np.full(len(total), depth, np.int32)), phrase.cast(pa.binary()).view(pa.string()), pa.array(total)]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "depth", "phrase", "f"])

    nodes = pieces.mapInArrow(rows, "lang string, depth int, phrase string, f long")
    return nodes.groupBy("lang", "depth", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("depth") == 0))


def _level(nodes: DataFrame, above: DataFrame | None, depth: int) -> DataFrame:
    """Nodes of a depth with the counts of their first parts (``lefts``) and rests (``rights``), shortest part of the phrase cut off first."""
    own = nodes.where(F.col("depth") == depth).select("lang", "phrase", "f")
    if above is None:
        none = F.array().cast("array<bigint>")
        return own.withColumns({"lefts": none, "rights": none})
    total = own.count()
    up = above.select("lang", F.col("phrase").alias("parent"), F.concat("lefts", F.array("f")).alias("lefts"), F.col("n_parent").alias("n"))
    link = above.select("lang", F.col("phrase").alias("link"), F.concat(F.array("f"), "rights").alias("rights"), F.col("n_link").alias("n"))
    return lookup(lookup(_with_edges(own, depth), up, ["lang", "parent"], "n", total), link, ["lang", "link"], "n", total)


def _with_edges(own: DataFrame, depth: int) -> DataFrame:
    """Adds the phrase of the parent and that of the suffix link."""
    return own.withColumn("parent", F.substring_index("phrase", " ", depth - 1)).withColumn("link", F.expr("substr(phrase, instr(phrase, ' ') + 1)"))


def _with_longer(level: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """Adds how often the longest-counted phrase with one more word occurs, and how many nodes have this one as parent and as link."""
    below = _with_edges(nodes.where(F.col("depth") == depth + 1), depth + 1)
    out = level
    for edge in ("parent", "link"):
        held = below.groupBy("lang", F.col(edge).alias("phrase")).agg(F.count("*").alias(f"n_{edge}"), F.max("f").alias(f"longer_{edge}"))
        out = out.join(held, ["lang", "phrase"], "left")
    longer = F.greatest(F.coalesce("longer_parent", F.lit(0)), F.coalesce("longer_link", F.lit(0)))
    return out.select("lang", "phrase", "f", "lefts", "rights", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_parent", "n_link")], longer.alias("longer"))


def _cuts(depth: int) -> Column:
    """The cuts of a phrase as structures of score, number of words of the first part, l and r; division of whole numbers of 38 digits."""
    out = []
    for k in range(1, depth):
        left, right = f"lefts[{k - 1}]", f"rights[{k - 1}]"
        score = F.expr(f"(cast(f as decimal(19, 0)) * {SCALE}BD) div (cast({left} as decimal(19, 0)) + {right})")
        out.append(F.struct(score.cast("long").alias("score"), F.lit(k).alias("k"), F.expr(left).alias("l"), F.expr(right).alias("r")))
    return F.array(*out)


def collocations(docs: DataFrame, least: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of 2 to 4 words of each language: lang, rank, phrase, a, l, r, n, score.

    A-Z count as a-z; null texts are empty, null languages are ``und``, ids and other columns are ignored,
    repeated rows count each. A phrase is kept if it occurs ``least`` times and no longer phrase that holds it
    occurs WITHIN hundredths as often. Ranks are by score, count and phrase. A language without such phrases has no row.
    """

    def build() -> DataFrame:
        nodes = materialize(frequent_nodes(docs, least), "phrases")
        above, found = None, []
        for depth in range(1, DEPTH + 1):
            above = materialize(_with_longer(_level(nodes, above, depth), nodes, depth), f"level{depth}")
            if depth > 1:
                whole = above.where(100 * F.col("longer") < WITHIN * F.col("f"))
                best = whole.select("lang", "phrase", F.col("f").alias("a"), F.array_min(_cuts(depth)).alias("cut"))
                found.append(best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
        scored = reduce(DataFrame.unionByName, found)
        order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
        part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
        first = scored.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
        ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
        words = nodes.where("depth = 0").select("lang", F.col("f").alias("n"))
        return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

    return finished(docs.sparkSession, build, "collocations")
