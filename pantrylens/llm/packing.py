"""Packing: concatenate all documents' token ids and cut the stream into fixed windows.

Two passes. The first tokenizes and writes each partition's ids with positions within the partition
and sums up partition totals; their prefix sums (one number per partition, on the driver) are the
global offsets. The second cuts every document at the multiples of the window. Only the last window
can be short, so there is next to no padding.

Defined cases: a null or empty text is the end id alone. Repeated rows are packed each. An empty
table gives no piece. The order of the stream is that of the written partitions and is not promised.
"""

from __future__ import annotations

import os
import string
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pantrylens.llm.shared import giving_back, saved

#: Words after which a task's cache starts anew; the words before stay at hand until it does so again.
CACHE_WORDS = 150_000
# Fixed value: how every special token of the vocabulary begins.
SPECIAL = b"<|"
#: Words that the tokenizer gets at once, and that go as one text.
BATCH_WORDS, TEXT_WORDS = 2_000, 300
PUNCTUATION = string.punctuation.encode()


class WordIds:
    """A tokenizer, kept from task to task, and the ids of the words that a task met lately."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.kind, self.code = (np.uint16, "H") if size <= 1 << 16 else (np.uint32, "I")
        self.ids: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.apart: dict[bytes, bool] = {}
        self.model = self.tokenizer.model if self._whole(string.ascii_lowercase) else None
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        #: Whether an id ends a word; None where the vocabulary does not tell.
        self.last = np.array([(self.tokenizer.id_to_token(k) or "").endswith(suffix) for k in range(size)]) if suffix else None

    def of(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The cache, with the ids of all ``words`` in it.

        Holds for tokenizers that drop white space and never join across it: a text's ids are then
        those of its words. Special tokens in a text are told by their exact spelling, as the tokenizer does.
        """
        if len(self.ids) > CACHE_WORDS:
            self.ids, self.before = {}, self.ids
        ids, before = self.ids, self.before
        new, cut = [], []
        for word in words:
            if word in ids:
                continue
            old = before.get(word)
            if old is not None:
                ids[word] = old
                continue
            stem, end = (word, b"") if word.isalpha() else self._parts(word)
            if end:
                cut.append((word, stem, end))
            else:
                new.append(word)
        for part in {x for _, stem, end in cut for x in (stem, end)}.difference(words):
            old = before.get(part)
            if part not in ids and old is None:
                new.append(part)
            elif old is not None:
                ids[part] = old
        self._encode(new)
        ids.update([(word, ids[stem] + ids[end]) for word, stem, end in cut])
        return ids

    def forget(self) -> None:
        """Empties the cache: the worker may go on with other work."""
        self.ids, self.before = {}, {}

    def _whole(self, word: str) -> bool:
        """Whether the tokenizer hands this word to its model as it is."""
        normal, cut = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        same = normal is None or normal.normalize_str(word) == word
        return same and cut is not None and [x for x, _ in cut.pre_tokenize_str(f"{word} {word}")] == [word, word]

    def _parts(self, word: bytes) -> tuple[bytes, bytes]:
        """A word without its last punctuation, and that, if the tokenizer sets it apart from letters and digits."""
        stem = word.rstrip(PUNCTUATION)
        if len(stem) == len(word) or not stem[-1:].isalnum() or SPECIAL in word:
            return word, b""
        end = word[len(stem) :]
        if end not in self.apart:
            cut = self.tokenizer.pre_tokenizer.pre_tokenize_str if self.tokenizer.pre_tokenizer else lambda x: [(x, (0, len(x)))]
            self.apart[end] = all(cut(x + end.decode())[0][1] == (0, 1) for x in "a0")
        return (stem, end) if self.apart[end] else (word, b"")

    def _encode(self, words: list[bytes]) -> None:
        """Words of a to z go to the model at once. Other words of letters go as one text: each is a piece, whose last id ends a word."""
        letters, alone = [], []
        for word in words:
            if self.model is not None and word.isalpha() and word.islower():
                self.ids[word] = array(self.code, [x.id for x in self.model.tokenize(word.decode())]).tobytes()
            else:
                (letters if self.last is not None and word.decode().isalpha() else alone).append(word)
        for lo in range(0, len(letters), TEXT_WORDS):
            some = letters[lo : lo + TEXT_WORDS]
            got = self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)
            ids = np.array(got[0].ids, dtype=self.kind)
            ends = ((np.flatnonzero(self.last[ids]) + 1) * ids.itemsize).tolist()
            if len(ends) == len(some):
                flat = ids.tobytes()
                self.ids.update([(w, flat[a:b]) for w, a, b in zip(some, [0, *ends], ends)])
            else:
                alone += some
        for lo in range(0, len(alone), BATCH_WORDS):
            some = alone[lo : lo + BATCH_WORDS]
            for word, got in zip(some, self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)):
                self.ids[word] = array(self.code, got.ids).tobytes()


_tokenizers: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


def words_of(text: bytes) -> list[bytes]:
    """Words in lower case, unless the text may hold special tokens, which have a case."""
    return (text if SPECIAL in text else text.lower()).split()


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, ``part``, ``at`` (ids before it in its partition), ``n_ids``, ``ids`` (little-endian)."""
    step_bytes = 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(1)
            size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0), dtype=np.int64)
            edges = np.flatnonzero(np.diff(np.cumsum(size) // step_bytes)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(size)]):
                split = [words_of((t or "").encode()) for t in texts[lo:hi].to_pylist()]
                known = word_ids(tokenizer_path).of(set().union(*split))
                kind = word_ids(tokenizer_path).kind
                last = np.array([end_id], dtype=kind).tobytes()
                ids = [b"".join(map(known.__getitem__, words)) + last for words in split]
                n = np.array([len(x) // kind().itemsize for x in ids], dtype=np.int64)
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], pa.array(np.full(len(n), part)), pa.array(starts), pa.array(n), pa.array(ids, pa.binary())],
                    names=[id_col, "part", "at", "n_ids", "ids"],
                )
        if tokenizer_path in _tokenizers:
            word_ids(tokenizer_path).forget()

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(giving_back(run), f"`{id_col}` {kind}, part long, at long, n_ids long, ids binary")


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    window: int = 2048,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: where it lies in its document and its sequence, and its ids (32-bit, little-endian)."""
    tokens = saved(tokenize(docs, tokenizer_path, end_id, id_col, text_col), "tokens")
    spark = docs.sparkSession
    totals = tokens.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    bases = np.cumsum([0, *(r["n"] for r in totals)])
    base = spark.sparkContext.broadcast({r["part"]: int(b) for r, b in zip(totals, bases)})
    kind_name = dict(tokens.dtypes)[id_col]
    names = [id_col, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, at, n = (np.asarray(batch.column(k)).astype(np.int64) for k in (1, 2, 3))
            if not len(n):
                continue
            begin = np.array([base.value[p] for p in part.tolist()], dtype=np.int64) + at
            first = begin // window
            pieces = (begin + n - 1) // window - first + 1
            doc = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = first[doc] + nth
            lo = np.maximum(begin[doc], sequence * window)
            hi = np.minimum(begin[doc] + n[doc], (sequence + 1) * window)
            start, length = lo - begin[doc], hi - lo
            blobs = batch.column(4).to_pylist()
            kind = np.uint16 if len(blobs[0]) == 2 * n[0] else np.uint32
            wide = [np.frombuffer(b, dtype=kind).astype("<u4") for b in blobs]
            ids = [wide[d][s : s + k].tobytes() for d, s, k in zip(doc.tolist(), start.tolist(), length.tolist())]
            for a in range(0, len(doc), 2000):
                b = a + 2000
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc[a:b])), pa.array(start[a:b]), pa.array(length[a:b]), pa.array(n[doc[a:b]])]
                    + [pa.array(sequence[a:b]), pa.array((lo - sequence * window)[a:b]), pa.array(ids[a:b], pa.binary())],
                    names=names,
                )

    schema = f"`{id_col}` {kind_name}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return tokens.select(id_col, "part", "at", "n_ids", "ids").mapInArrow(giving_back(cut), schema)
