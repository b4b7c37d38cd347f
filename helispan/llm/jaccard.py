"""N-gram Jaccard join with a token-group matrix.

Documents are sets of word shingles. Equal sets are one set with copies. Two rules tell which sets can
be linked at all, both in one fixed order of all tokens. Any order gives the same links; this one
begins with rare tokens, told by a table of counts of all tokens by hash bucket.

* A linked set has most of its tokens in common with another. So of the first tokens of each set, twice
  as many as may be its own, it is counted which are found in any other set; a set with too many of its
  own has no partner and is alone.
* Prefix rule: two sets within the threshold share several tokens, not just one, among the first few
  of each; the larger the sets, the more.

Sets connected by shared prefix tokens are put in order of their least token and dealt to groups of sets that a sketch, a bit map of hash
buckets, lets be similar to the group's first. A group's row of the token-group matrix is the union of
its tokens, and beside each token a word with a bit for every set that holds it. Only groups that share
enough tokens of their sets' prefixes meet, so sets that are merely chained together by single tokens
move nothing; where two groups meet, their rows are opened, and there the unions bound each set's
overlap once more before intersections are counted. All counts are exact integers.

Sets are compared by 64-bit hashes of shingles, and told apart by a 64-bit hash of the set; two
different ones among n fall together with a chance of about n * n / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helispan.llm.arrow import batch_of, bound_batches, bundles, runs
from helispan.llm.links import SCHEMA, Links
from helispan.llm.text import hashed_words, mix, shingle_hashes, slices
from helispan.operators.graph import connected_components
from helispan.session import finished, materialize

WORDS = 3
PERCENT = 90
#: Sets in a group (bits of a word), and tokens after which a group is closed before.
GROUP = 64
GROUP_TOKENS = 100_000
#: Groups and tokens of a panel; a task compares two panels.
PANEL = 64
PANEL_TOKENS = 400_000
#: Buckets of the table of token counts, and how many of them travel in a row.
BUCKETS = 1 << 20
ROW = 1 << 12
STEPS = 8
#: Groups of a component that may still grow.
OPEN = 16
#: Tables up to so many rows of two or three numbers are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000

_SEED = mix(np.arange(1, 3, dtype=np.uint64))
_BUCKET_SHIFT = np.uint64(64 - BUCKETS.bit_length() + 1)


def _sid(tokens: np.ndarray) -> int:
    return int(mix(np.add.reduce(mix(tokens + _SEED[0]), keepdims=True) + np.uint64(len(tokens))).view(np.int64)[0])


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """Per document: doc_id, text_key (hash of the text), n, sid (hash of the set, null if empty), least (its least token).

    Rows with ``at`` are not documents: they hold the task's counts of tokens, ROW buckets each.
    """
    names = ["doc_id", "text_key", "n", "sid", "least", "at", "counts"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(BUCKETS, np.uint32)
        for batch in batches:
            for at, off, raw in slices(batch.column(2)):
                n, sid, least, seen = [], [], [], []
                for tokens in shingle_hashes(*hashed_words(off, raw), k):
                    n.append(len(tokens))
                    sid.append(_sid(tokens) if len(tokens) else None)
                    least.append(int(tokens[:1].view(np.int64)[0]) if len(tokens) else None)
                    seen.append(tokens >> _BUCKET_SHIFT)
                bucket, times = np.unique(np.concatenate(seen), return_counts=True)
                count[bucket.astype(np.int64)] += times.astype(np.uint32)
                none = pa.nulls(len(n))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, len(n)) for i in (0, 1)), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(least, pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())], names=names)
        table = count.astype("<u4").reshape(-1, ROW)
        some = np.flatnonzero(table.any(axis=1))
        none = pa.nulls(len(some)).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, none, pa.array(some, pa.int32()), pa.array([table[i].tobytes() for i in some], pa.binary())], names=names)

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return keyed.mapInArrow(rows, "doc_id long, text_key long, n long, sid long, least long, at int, counts binary")


def _commonness(sets: DataFrame) -> np.ndarray:
    """How common each bucket's tokens are in all documents, in STEPS steps for each power of two; a byte for each of BUCKETS."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[at] = sums.get(at, 0) + np.frombuffer(counts, "<u4").astype(np.uint64)
        level = {at: np.minimum(STEPS * np.log2(s + 1.0), 255).astype(np.uint8).tobytes() for at, s in sums.items()}
        yield pa.RecordBatch.from_arrays([pa.array(list(level), pa.int32()), pa.array(list(level.values()), pa.binary())], names=["at", "level"])

    out = np.zeros(BUCKETS, np.uint8)
    # BUCKETS bytes in BUCKETS / ROW rows, whatever the input.
    for r in sets.where("at is not null").select("at", "counts").repartition("at").mapInArrow(total, "at int, level binary").collect():
        out[r["at"] * ROW : (r["at"] + 1) * ROW] = np.frombuffer(bytes(r["level"]), np.uint8)
    return out


def own_tokens(n: int, percent: int) -> int:
    """How many of its ``n`` tokens a set can have that a linked one lacks."""
    return n - -(-percent * n // 100)


def first_tokens(tokens: np.ndarray, common: np.ndarray, count: int) -> np.ndarray:
    """The first ``count`` tokens of a set in the order of all tokens, rare ones first."""
    if count >= len(tokens):
        return tokens
    key = (common[(tokens >> _BUCKET_SHIFT).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (mix(tokens ^ _SEED[1]) >> np.uint64(8))
    return tokens[np.argpartition(key, count - 1)[:count]]


def prefix_share(n: int, percent: int) -> int:
    """How many tokens two linked sets, the smaller of ``n`` tokens, have in common in their prefixes at least."""
    return own_tokens(n, percent) // 2 + 1


def prefix(tokens: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """The first tokens of a set, of which two sets within the threshold share ``prefix_share``.

    Two linked sets have all but ``own_tokens`` of either in common, so the first k of the common ones
    are among the first own_tokens + k of each.
    """
    return first_tokens(tokens, common, own_tokens(len(tokens), percent) + prefix_share(len(tokens), percent))


def _shared(docs: DataFrame, common: np.ndarray, k: int, percent: int) -> DataFrame:
    """``sid, shared``: in how many of a set's first tokens others have a part, at least; sets without any are missing.

    The first tokens are 2 * (own_tokens + 1). Those found in several sets of a batch are counted before
    the shuffle, and one row of each goes on, so that a token of many sets moves few rows.
    """
    table = docs.sparkSession.sparkContext.broadcast(common)

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in batches:
            for _, off, raw in slices(batch.column(0)):
                tokens, owners = [], []
                for t in shingle_hashes(*hashed_words(off, raw), k):
                    if len(t) and (s := _sid(t)) not in known:
                        known.add(s)
                        tokens.append(first_tokens(t, table.value, 2 * own_tokens(len(t), percent) + 2))
                        owners.append(s)
                if not tokens:
                    continue
                token, sid = np.concatenate(tokens).view(np.int64), np.repeat(np.array(owners, np.int64), [len(t) for t in tokens])
                order = np.argsort(token, kind="stable")
                token, sid = token[order], sid[order]
                first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
                rows = np.diff(np.append(first, len(token)))
                here, times = np.unique(sid[np.repeat(rows > 1, rows)], return_counts=True)
                # Rows of a token and its set (0) or sets (-1), and rows of what is counted here, by set.
                columns = (np.concatenate([token[first], here]), np.concatenate([sid[first], here]), np.concatenate([-(rows > 1).astype(np.int32), times.astype(np.int32)]))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "sid", "shared"])

    def counted(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        token, sid, several = (np.concatenate(c) for c in zip(*held, strict=True))
        first = np.concatenate(([True], token[1:] != token[:-1]))
        of = np.cumsum(first) - 1
        some = np.zeros(int(of[-1]) + 1, bool)
        some[of[several | (sid != sid[first][of])]] = True
        found, times = np.unique(sid[some[of] & ~several], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array(times.astype(np.int32))], names=["sid", "shared"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            key, sid, shared = (batch.column(i).to_numpy() for i in range(3))
            done = shared > 0
            yield pa.RecordBatch.from_arrays([pa.array(sid[done]), pa.array(shared[done])], names=["sid", "shared"])
            rows = key[~done], sid[~done], shared[~done] < 0
            if not len(rows[0]):
                continue
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            if cut or (held and held[-1][0][-1] != rows[0][-1]):
                yield counted([*held, tuple(c[:cut] for c in rows)])
                held = []
            held.append(tuple(c[cut:] for c in rows))
        if held:
            yield counted(held)

    posted = docs.select("text").mapInArrow(postings, "key long, sid long, shared int")
    each = posted.repartition("key").sortWithinPartitions("key").mapInArrow(count, "sid long, shared int")
    return each.groupBy("sid").agg(F.sum("shared").alias("shared"))


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))], names=["src", "dst"])


def _candidates(tokens: DataFrame, common: np.ndarray, percent: int) -> DataFrame:
    """Edges ``src, dst`` that connect all sets with a prefix token in common, as stars around one of them.

    Sets of a batch are linked before the shuffle and only one of them goes on, so that a token that
    many sets share moves few rows.
    """
    table = tokens.sparkSession.sparkContext.broadcast(common)

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            at, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            found = [prefix(values[i:j], table.value, percent) for i, j in zip(at[:-1], at[1:], strict=True)]
            if not found:
                continue
            token, sid = np.concatenate(found).view(np.int64), np.repeat(batch.column(0).to_numpy(), [len(t) for t in found])
            order = np.lexsort((sid, token))
            token, sid = token[order], sid[order]
            first = np.concatenate(([True], token[1:] != token[:-1]))
            root = sid[first][np.cumsum(first) - 1]
            linked = _pairs(sid[sid != root], root[sid != root])
            src, dst = linked.column(0).to_numpy(), linked.column(1).to_numpy()
            key = mix(mix(src.view(np.uint64)) + dst.view(np.uint64)).view(np.int64)
            columns = (np.concatenate([token[first], key]), np.concatenate([sid[first], src]), np.concatenate([sid[first], dst]))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "src", "dst"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            token, src, dst = (batch.column(i).to_numpy() for i in range(3))
            done = src != dst
            yield _pairs(src[done], dst[done])
            token, src = token[~done], src[~done]
            if not len(token):
                continue
            first = np.concatenate(([last is None or token[0] != last], token[1:] != token[:-1]))
            roots = src[first] if first[0] else np.concatenate(([held], src[first]))
            root = roots[np.cumsum(first) - (1 if first[0] else 0)]
            yield _pairs(src[src != root], root[src != root])
            last, held = token[-1], root[-1]

    posted = tokens.select("sid", "tokens").mapInArrow(postings, "token long, src long, dst long")
    return posted.repartition("token").sortWithinPartitions("token").mapInArrow(links, "src long, dst long")


def sketch(tokens: np.ndarray) -> bytes:
    """A bit map of the hash buckets of a set's tokens, with four buckets or more for each."""
    size = max(64, 1 << (4 * max(len(tokens), 1) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(mix(tokens ^ _SEED[1]) & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def most_common_tokens(a: bytes, n: int, b: bytes, m: int) -> int:
    """No two sets of ``n`` and ``m`` tokens with these sketches have more tokens in common."""
    one, two = (np.frombuffer(x, np.uint64) for x in (a, b))
    while len(one) > len(two):
        one = one.reshape(2, -1)[0] | one.reshape(2, -1)[1]
    while len(two) > len(one):
        two = two.reshape(2, -1)[0] | two.reshape(2, -1)[1]
    both, x, y = (int(np.bitwise_count(v).sum()) for v in (one & two, one, two))
    return both + min(n - x, m - y)


def _grouped(tokens: DataFrame, alive: DataFrame, percent: int) -> DataFrame:
    """``sid, copies, gid, panel``: groups of sets of one component that may be similar to the group's first set."""
    near = max(2 * percent - 100, 0)  # as two sets have that are linked with a third

    def similar(n: int, bits: bytes, m: int, others: bytes) -> bool:
        most = near * max(n, m)
        return 100 * min(n, m) >= most and 100 * most_common_tokens(bits, n, others, m) >= most

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = panel = TaskContext.get().partitionId() << 32
        of = last = None
        groups = held = 0
        leaders: list[list] = []  # gid, panel, sets, tokens; n and sketch of the first
        for batch in batches:
            cells = []
            for component, _, n, sid, copies, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sid == last:
                    continue  # a set found by several tasks counts once
                last = sid
                if component != of:
                    of, panel, groups, held, leaders = component, panel + 1, 0, 0, []
                if groups and held + n > PANEL_TOKENS:
                    panel, groups, held, leaders = panel + 1, 0, 0, []
                fit = next((g for g in leaders if g[2] < GROUP and g[3] + n <= GROUP_TOKENS and similar(n, bits, g[4], g[5])), None)
                if fit is None:
                    if groups == PANEL:
                        panel, groups, held, leaders = panel + 1, 0, 0, []
                    made, groups = made + 1, groups + 1
                    fit = [made, panel, 0, 0, n, bits]
                leaders = [*[g for g in leaders if g is not fit][-OPEN + 1 :], fit]
                fit[2], fit[3], held = fit[2] + 1, fit[3] + n, held + n
                cells.append((sid, copies, fit[0], fit[1]))
            yield batch_of(cells, [(c, pa.int64()) for c in ("sid", "copies", "gid", "panel")])

    keys = ["component", "least", "n", "sid"]
    sets = materialize(tokens.select("sid", "sketch").join(alive.select("sid", "component", "least", "n", "copies"), "sid"), "sketches")
    ordered = sets.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*keys, "copies", "sketch")
    return ordered.mapInArrow(number, "sid long, copies long, gid long, panel long")


_MATRIX = "panel long, gid long, low long, high long, sids array<long>, copies array<long>, ns array<long>, tokens array<long>, words array<long>, first array<long>"


def _matrix(tokens: DataFrame, common: np.ndarray, percent: int) -> DataFrame:
    """One row per group: its sets, the union of their tokens, a word of bits for each token, and the union of their prefixes."""
    table = tokens.sparkSession.sparkContext.broadcast(common)
    kinds = [*((c, pa.int64()) for c in ("panel", "gid", "low", "high")), *((c, pa.list_(pa.int64())) for c in ("sids", "copies", "ns", "tokens", "words", "first"))]

    def row(batch: pa.RecordBatch) -> list:
        sid, lists = batch.column(2).to_numpy(), batch.column(4)
        _, first = np.unique(sid, return_index=True)  # a set found by several tasks counts once
        at, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        sets = [values[at[i] : at[i + 1]] for i in first]
        n = np.array([len(s) for s in sets])
        union, column = np.unique(np.concatenate(sets), return_inverse=True)
        words = np.zeros(len(union), np.uint64)
        np.bitwise_or.at(words, column, np.repeat(np.uint64(1) << np.arange(len(sets), dtype=np.uint64), n))
        prefixes = np.unique(np.concatenate([prefix(s.view(np.uint64), table.value, percent) for s in sets]))
        heads = [batch.column(i)[0].as_py() for i in range(2)]
        return [*heads, int(n.min()), int(n.max()), sid[first], batch.column(3).to_numpy()[first], n, union, words.view(np.int64), prefixes.view(np.int64)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held = [], 0
        for batch in runs(batches, 1):
            made.append(row(batch))
            held += len(made[-1][-3])
            if held >= PANEL_TOKENS:
                yield batch_of(made, kinds)
                made, held = [], 0
        if made:
            yield batch_of(made, kinds)

    return tokens.repartition("gid").sortWithinPartitions("gid").mapInArrow(rows, _MATRIX)


def _tokens(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """``sid, tokens, sketch`` of the sets asked for by text_key and sid, from one text of each (of each task)."""
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked.hint("shuffle_hash")
    texts = docs.select("text", F.xxhash64("text").alias("text_key")).join(asked, "text_key")
    kinds = [("sid", pa.int64()), ("tokens", pa.list_(pa.int64())), ("sketch", pa.binary())]

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in batches:
            sids = batch.column(0).to_pylist()
            for at, off, raw in slices(batch.column(1)):
                rows = []
                for s, t in zip(sids[at : at + len(off) - 1], shingle_hashes(*hashed_words(off, raw), k), strict=True):
                    if len(t) and s not in known and _sid(t) == s:
                        known.add(s)
                        rows.append((s, t.view(np.int64), sketch(t)))
                yield batch_of(rows, kinds)

    return texts.select("sid", "text").mapInArrow(tokens, "sid long, tokens array<long>, sketch binary")


def _opened(matrix: DataFrame, percent: int) -> DataFrame:
    """``x, y, gid, second``: groups to open for a pair of panels, those that share enough of their prefixes.

    Groups of one panel all meet; a panel of one set meets nothing by itself.
    """
    posted = matrix.select("gid", "low", "high", F.explode("first").alias("token"))
    a, b = posted.alias("a"), posted.alias("b")
    near = (100 * F.col("a.high") >= percent * F.col("b.low")) & (100 * F.col("b.high") >= percent * F.col("a.low"))
    met = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.gid") < F.col("b.gid")) & near)
    least = F.least("a.low", "b.low")
    pairs = met.groupBy(F.col("a.gid").alias("p"), F.col("b.gid").alias("q")).agg(F.count("*").alias("shared"), F.min(least).alias("least"))
    enough = F.col("shared") > F.floor((F.col("least") - F.ceil(F.lit(percent) * F.col("least") / 100)) / 2)  # prefix_share
    heads = matrix.select("gid", "panel", F.size("sids").alias("sets"))
    panels = heads.select("gid", "panel")
    kept = pairs.where(enough).select("p", "q").join(panels.toDF("p", "x"), "p").join(panels.toDF("q", "y"), "q").where("x <> y")
    sides = F.explode(F.array(F.struct(F.col("p").alias("gid"), F.lit(False).alias("second")), F.struct(F.col("q").alias("gid"), F.lit(True).alias("second")))).alias("side")
    across = kept.select("x", "y", sides).select("x", "y", "side.gid", "side.second").distinct()
    several = heads.groupBy("panel").agg(F.sum("sets").alias("sets")).where("sets > 1").select("panel")
    within = heads.join(several, "panel").select(F.col("panel").alias("x"), F.col("panel").alias("y"), "gid", F.lit(False).alias("second"))
    return within.unionByName(across)


def overlaps(a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray], percent: int) -> np.ndarray:
    """Which sets of group ``a`` are linked with which of group ``b``, each given by its tokens, words and sizes.

    The tokens of both unions bound a set's overlap with any set of the other group; sets with too
    small a bound are not opened.
    """
    (tokens, words, n), (others, their, m) = a, b
    found = np.zeros((len(n), len(m)), dtype=bool)
    if tokens is others:
        i = j = np.arange(len(tokens))
    else:
        at = np.minimum(np.searchsorted(others, tokens), len(others) - 1)
        i = np.flatnonzero(others[at] == tokens)
        j = at[i]
    need = max(int(n.min()), int(m.min()))
    if 100 * len(i) < percent * need:
        return found

    def bits(w: np.ndarray, count: int) -> np.ndarray:
        return np.unpackbits(w.view(np.uint8).reshape(-1, 8), axis=1, count=count, bitorder="little")

    one, two = bits(words[i], len(n)), bits(their[j], len(m))
    left, right = np.flatnonzero(100 * one.sum(axis=0, dtype=np.int64) >= percent * n), np.flatnonzero(100 * two.sum(axis=0, dtype=np.int64) >= percent * m)
    if len(left) and len(right):
        both = np.rint(one[:, left].T.astype(np.float32) @ two[:, right].astype(np.float32)).astype(np.int64)
        found[np.ix_(left, right)] = 100 * both >= percent * (n[left][:, None] + m[right][None, :] - both)
    return found


def _verified(batch: pa.RecordBatch, percent: int) -> pa.RecordBatch:
    """Links of the opened groups of two panels, or of one with itself."""
    second = batch.column("second").to_numpy(zero_copy_only=False)

    def lists(name: str) -> list[np.ndarray]:
        at, values = batch.column(name).offsets.to_numpy(), batch.column(name).values.to_numpy()
        return [values[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]

    groups = [(t, w.view(np.uint64), n) for t, w, n in zip(lists("tokens"), lists("words"), lists("ns"), strict=True)]
    links = Links(np.concatenate(lists("copies")))
    at = np.cumsum([0, *(len(g[2]) for g in groups)])
    own = [np.arange(i, j) for i, j in zip(at[:-1], at[1:], strict=True)]
    alone = batch.column("x")[0] == batch.column("y")[0]
    for i in range(len(groups)):
        for j in range(i, len(groups)) if alone else np.flatnonzero(second) if not second[i] else ():
            found = overlaps(groups[i], groups[j], percent)
            if i == j:
                np.fill_diagonal(found, False)
            if found.any():
                links.add(own[i], own[j], found, both=i != j)
    return links.rows(np.concatenate(lists("sids")))


def _links(tokens: DataFrame, grouped: DataFrame, common: np.ndarray, percent: int) -> DataFrame:
    """``src, dst, links``: connects each linked set with one of its sets, and counts its links in all rows."""
    groups = F.broadcast(grouped) if grouped.count() <= BROADCAST_ROWS else grouped
    matrix = materialize(_matrix(tokens.select("sid", "tokens").join(groups, "sid").select("panel", "gid", "sid", "copies", "tokens"), common, percent), "matrix")
    opened = materialize(_opened(matrix, percent), "opened")
    asked = F.broadcast(opened) if opened.count() <= BROADCAST_ROWS else opened

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in bundles(runs(batches, 0, 1), 200):
            yield pa.concat_batches([_verified(b, percent) for b in some])

    rows = matrix.select("gid", "sids", "copies", "ns", "tokens", "words").join(asked, "gid").select("x", "y", "second", "sids", "copies", "ns", "tokens", "words")
    return rows.repartition("x", "y").sortWithinPartitions("x", "y").mapInArrow(verify, SCHEMA)


def _classes(docs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """``sid, component_id, best_key, n_links`` of the sets that have copies or links; the others are alone.

    A class is named after its document of least id, of equal ones the one of least text_key.
    """
    spark = docs.sparkSession
    first = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_key")
    own = sets.where("sid is not null")
    each = own.groupBy("sid").agg(F.min(first).alias("first"), F.max("n").alias("n"), F.max("least").alias("least"), F.count("*").alias("copies"))
    each = materialize(each.select("*", F.col("first.text_key").alias("text_key")), "each")
    common = _commonness(sets)
    own_most = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100)
    first_n = F.least(F.col("n"), 2 * own_most + 2)
    alive = materialize(each.join(_shared(docs, common, k, percent), "sid").where(first_n - F.col("shared") <= own_most).drop("shared"), "alive")
    tokens = materialize(_tokens(docs, alive.select("text_key", "sid"), k), "tokens")
    near = connected_components(_candidates(tokens, common, percent)).withColumnRenamed("node", "sid")
    grouped = materialize(_grouped(tokens, alive.join(near, "sid"), percent), "groups")
    links = finished(spark, lambda: _links(tokens, grouped, common, percent), "links")
    joined = connected_components(links).withColumnRenamed("node", "sid")
    counts = links.groupBy(F.col("src").alias("sid")).agg(F.sum("links").alias("links"))
    part = each.join(joined, "sid", "left").join(counts, "sid", "left").where("copies > 1 or component is not null")
    part = part.withColumn("component", F.coalesce("component", "sid"))
    best = part.groupBy("component").agg(F.min("first").alias("best"))
    return part.join(best, "component").select("sid", F.col("best.doc_id").alias("component_id"), F.col("best.text_key").alias("best_key"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))


def _rows(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Per document: doc_id, text_key, n_shingles, component_id, n_links, and ``best_key``, null where it is alone."""
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select("doc_id", "text")
    sets = materialize(_sets(docs, k), "sets")
    known = finished(spark, lambda: _classes(docs, sets, k, percent), "known")
    # Copies share a key; beyond the bound, the join is one whose hot partitions Spark splits.
    known = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    out = sets.where("at is null").select("doc_id", "text_key", F.col("n").alias("n_shingles"), "sid").join(known, "sid", "left")
    component = F.when(F.col("n_links").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "best_key")


def join(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, n_links.

    Documents link when their sets of ``k``-word shingles have a Jaccard similarity of at least
    ``percent`` in 100. A null or empty text has no shingle, links with nothing and is its own component;
    equal sets link whatever their number; ``component_id`` is the least id of a component (null only
    if all are), and a row repeated, or another text under the same id or under none, counts as another
    document. Other columns are ignored.
    """
    return _rows(docs, k, percent).drop("text_key", "best_key")


def deduplicate(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each component, with all columns: the one of the least id (null ids last).

    Of several texts under that id one stays, and of rows with that text one. Documents without words stay.
    """
    classes = finished(docs.sparkSession, lambda: _rows(docs, k, percent).where("best_key is not null"), "members")
    best = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("best_key"))
    gone = classes.where(~best).select("doc_id", "text_key").distinct()
    again = classes.where(best).groupBy("doc_id", "text_key").count().where("count > 1").select("doc_id", "text_key")
    own = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(docs.columns)], F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_key"))

    def matched(left: DataFrame, ids: DataFrame, how: str) -> DataFrame:
        ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
        return left.join(ids, left["_id"].eqNullSafe(ids["doc_id"]) & (left["_key"] == ids["text_key"]), how)

    kept = matched(own, gone, "left_anti")
    if not again.isEmpty():
        kept = matched(kept, again, "left_anti").unionByName(matched(kept, again, "left_semi").dropDuplicates(["_id", "_key"]))
    return kept.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(docs.columns)])
