"""Token counts by a count-only Viterbi search over a unigram piece vocabulary.

An Aho-Corasick automaton lists all pieces that end at each character; one forward pass carries the
best score and its number of pieces, and never a back pointer. Ties follow the unigram tokenizers:
of equal scores the path met first wins, which is that with the longest last piece. A character that
no one-character piece covers may be taken alone as unknown, at 10 below the least score; with byte
pieces it counts as its UTF-8 bytes, else a run of unknown characters counts as one.

Spaces become the mark that pieces carry. The mark starts pieces only, so words are independent of
each other and a worker keeps the results of words in a bounded cache.

Defined cases: a null or empty text has 0 tokens and score 0. Rows are counted one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pantrylens.llm.pieces import CHUNK, MARK, Vocabulary, load

UNKNOWN_PENALTY = 10.0
#: Entries of a worker's cache; a full cache is emptied.
CACHE_CHUNKS = 400_000


class Counter:
    """Best score and number of tokens of a text."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.single: set[str] = set()
        for piece, score, ok in zip(vocabulary.pieces, vocabulary.scores, vocabulary.normal):
            if ok:
                self.automaton.add_word(piece, (len(piece), score))
                if len(piece) == 1:
                    self.single.add(piece)
        self.automaton.make_automaton()
        self.bytes = bool(vocabulary.byte_ids)
        self.unknown = min(vocabulary.scores) - UNKNOWN_PENALTY
        self.chunked = vocabulary.chunked
        self.cache: dict[str, tuple[float, int]] = {}

    def search(self, text: str) -> tuple[float, int]:
        """One forward pass over ``text``, whose spaces are marks already."""
        n = len(text)
        best = [-np.inf] * (n + 1)
        count = [0] * (n + 1)
        best[0] = 0.0
        alone = [c not in self.single for c in text]
        if not any(alone):
            for end, (length, score) in self.automaton.iter(text):
                end += 1
                total = best[end - length] + score
                if total > best[end]:
                    best[end] = total
                    count[end] = count[end - length] + 1
            return best[n], count[n]
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, found in self.automaton.iter(text):
            ends[end].append(found)
        by_unknown = [False] * (n + 1)
        for k in range(n):
            for length, score in ends[k]:
                total = best[k + 1 - length] + score
                if total > best[k + 1]:
                    best[k + 1] = total
                    count[k + 1] = count[k + 1 - length] + 1
            if alone[k] and best[k] + self.unknown > best[k + 1]:
                best[k + 1] = best[k] + self.unknown
                by_unknown[k + 1] = True
                count[k + 1] = count[k] + (len(text[k].encode()) if self.bytes else 0 if by_unknown[k] else 1)
        return best[n], count[n]

    def __call__(self, text: str) -> tuple[float, int]:
        if not text:
            return 0.0, 0
        if not self.chunked:
            return self.search(text.replace(" ", MARK))
        cache = self.cache
        total, count = 0.0, 0
        for chunk in CHUNK.findall(text):
            got = cache.get(chunk)
            if got is None:
                if len(cache) >= CACHE_CHUNKS:
                    cache.clear()
                got = self.search(chunk.replace(" ", MARK))
                if len(chunk) <= 64:
                    cache[chunk] = got
            total += got[0]
            count += got[1]
        return total, count


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(load(path))
    return _counters[path]


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", prefix: str = " ") -> DataFrame:
    """Id, ``n_chars``, ``n_tokens`` and ``best_score`` of each whole text.

    ``prefix`` is put before every text that is not empty, as the vocabulary's tokenizer does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(model_path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                texts = [t or "" for t in batch.column(1)[lo : lo + 500].to_pylist()]
                got = [of(prefix + t) if t else (0.0, 0) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[lo : lo + 500],
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.array([c for _, c in got], pa.int64()),
                        pa.array([s for s, _ in got], pa.float64()),
                    ],
                    names=[id_col, "n_chars", "n_tokens", "best_score"],
                )

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_chars long, n_tokens long, best_score double")
