"""Token counts under a unigram vocabulary by a count-only Viterbi search.

An Aho-Corasick automaton finds every piece of the vocabulary that ends at a character; the dynamic
program carries the best score and its number of pieces, and no path. The rules are those of the
public unigram tokenizer: of equal scores the earliest start wins, a character without a piece of its
own costs the least score less 10, and such characters count as their UTF-8 bytes. Blanks become
U+2581, which begins a chunk; chunks are counted on their own, each distinct one once.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helispan.llm.arrow import bound_batches

PIECES = tokenizer_path("piece_bpe_32k.model")
MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Chunks that a worker keeps at least; it keeps up to twice as many.
CACHE = 100_000
LONGEST_KEPT = 48


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a public vocabulary file, in the order of their ids."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter(dict):
    """The number of tokens of a text under a unigram vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        super().__init__()
        self.old: dict[str, int] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.longest = max(len(p) for p, _ in pieces)
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY

    def best(self, chunk: str) -> int:
        """Pieces of the best path through a chunk; as many scores are kept as the longest piece has characters."""
        kept = self.longest + 1
        scores, counts = [0.0] * kept, [0] * kept
        matches = self.automaton.iter(chunk)
        match = next(matches, None)
        for last, char in enumerate(chunk):
            best, count = None, 0
            while match is not None and match[0] == last:  # the longest first
                length, score = match[1]
                at = (last + 1 - length) % kept
                s = scores[at] + score
                if best is None or s > best:
                    best, count = s, counts[at] + 1
                match = next(matches, None)
            if char not in self.single:
                s = scores[last % kept] + self.unknown
                if best is None or s > best:
                    best, count = s, counts[last % kept] + len(char.encode())
            scores[(last + 1) % kept], counts[(last + 1) % kept] = best, count
        return counts[len(chunk) % kept]

    def __missing__(self, part: str) -> int:
        found = self.old.get(part)
        if found is None:
            found = self.best(MARK + part)
        if len(part) <= LONGEST_KEPT:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[part] = found
        return found

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        marked = text.replace(" ", MARK)
        return sum(map(self.__getitem__, (marked if marked[0] == MARK else MARK + marked).split(MARK)[1:]))


_COUNTERS: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, path: str = PIECES) -> DataFrame:
    """``doc_id, n_tokens`` per document. A null or empty text has none; repeated rows repeat; nothing is shuffled."""

    bound_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _COUNTERS:
            _COUNTERS[path] = Counter(vocabulary(path))
        counter = _COUNTERS[path]
        for batch in batches:
            n = pa.array([counter(t) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, n_tokens long")
