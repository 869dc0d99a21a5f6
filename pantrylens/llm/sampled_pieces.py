"""Sampled segmentations by forward filtering and backward sampling over the piece lattice.

Forward: for each distinct chunk (spaces and the word after them) the log-sum of the weights of all
segmentations up to each character. Backward: each occurrence draws its last piece, then the one
before it, and so on, each with its exact posterior probability. The draw at a character depends on
the seed, the row's key and the character's place in the row only, so a row is segmented alike in
any partitioning. Whole batches of occurrences take each step together in numpy.

Encoding is lossless: a space is the mark, a mark or any character without a one-character piece is
its UTF-8 bytes. Decoding joins the pieces again.

Defined cases: a null or empty text has no piece. Rows with equal keys and texts get equal pieces. A
null key counts as the text "null".
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pantrylens.llm.pieces import MARK, Vocabulary, load, zipf_scores
from pantrylens.llm.shared import mixed, powers, text_bytes

SPACE, MARK_CODE, LITERAL_MARK = 0x20, ord(MARK), 0x110000
#: Characters that one numpy step works on; a longer text is a step of its own.
STEP_CHARS = 300_000


def code_hash_sums(codes: np.ndarray) -> np.ndarray:
    up, _ = powers(len(codes))
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum((mixed(codes.astype(np.uint64) + np.uint64(0x51ED27))) * up, out=sums[1:])
    return sums


def code_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mixed((sums[end] - sums[start]) * down[start])


class HashTable:
    """64-bit keys to small numbers, looked up in whole arrays; missing keys give -1."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(8, int(len(keys) * 4).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, dtype=np.uint64)
        self.values = np.full(1 << bits, -1, dtype=np.int64)
        for key, value in zip(keys.tolist(), values.tolist()):
            slot = key & int(self.mask)
            while self.values[slot] >= 0:
                slot = (slot + 1) & int(self.mask)
            self.keys[slot], self.values[slot] = key, value

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = keys & self.mask
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        while len(left):
            value = self.values[slot]
            hit = (self.keys[slot] == keys[left]) & (value >= 0)
            out[left[hit]] = value[hit]
            on = ~hit & (value >= 0)
            left, slot = left[on], (slot[on] + np.uint64(1)) & self.mask
        return out


class Sampler:
    def __init__(self, vocabulary: Vocabulary, temperature: float):
        if not vocabulary.chunked:
            raise ValueError("pieces reach across words; this sampler works word by word")
        self.byte_ids = np.array(vocabulary.byte_ids, dtype=np.int64)
        if len(self.byte_ids) != 256:
            raise ValueError("without byte pieces encoding is not lossless")
        log_weights = np.array(zipf_scores(vocabulary)) / temperature
        ids = [i for i, ok in enumerate(vocabulary.normal) if ok]
        codes = np.frombuffer("".join(vocabulary.pieces[i] for i in ids).encode("utf-32-le"), dtype=np.uint32)
        length = np.array([len(vocabulary.pieces[i]) for i in ids])
        end = np.cumsum(length)
        self.longest = int(length.max())
        sums = code_hash_sums(codes)
        self.table = HashTable(code_hash(sums, end - length, end), np.array(ids))
        starts = [np.unique(code_hash(sums, (end - length)[length >= k], (end - length)[length >= k] + k)) for k in range(1, self.longest + 1)]
        self.prefixes = [HashTable(s, np.zeros(len(s), dtype=np.int64)) for s in starts]
        self.weights = log_weights
        self.unknown = 3 * float(log_weights.min())

    def lattice(self, codes: np.ndarray, begin: np.ndarray, end: np.ndarray):
        """Edges of chunks laid end to end in ``codes``, sorted by their ends: start, end, piece (or -1 - code)."""
        n = len(codes)
        limit = np.repeat(end, end - begin)
        sums = code_hash_sums(codes)
        at = np.arange(n)
        starts, ends, ids = [], [], []
        single = np.zeros(n, dtype=bool)
        for k in range(1, self.longest + 1):
            at = at[at + k <= limit[at]]
            h = code_hash(sums, at, at + k)
            alive = self.prefixes[k - 1].get(h) >= 0
            at, h = at[alive], h[alive]
            piece = self.table.get(h)
            hit = piece >= 0
            starts.append(at[hit])
            ends.append(at[hit] + k)
            ids.append(piece[hit])
            if k == 1:
                single[at[hit]] = True
                rest = np.flatnonzero(~single)
                starts.append(rest)
                ends.append(rest + 1)
                ids.append(-1 - codes[rest].astype(np.int64))
        start, stop, piece = (np.concatenate(x) for x in (starts, ends, ids))
        order = np.argsort(stop, kind="stable")
        return start[order], stop[order], piece[order]

    def filtered(self, codes: np.ndarray, begin: np.ndarray, end: np.ndarray):
        """Forward pass. Returns the edges, and for each edge its cumulative posterior among those of its end."""
        start, stop, piece = self.lattice(codes, begin, end)
        weight = np.where(piece >= 0, self.weights[np.maximum(piece, 0)], self.unknown)
        n = len(codes)
        # alpha at a character's left side; chunk starts are 0
        chunk_of = np.repeat(np.arange(len(begin)), end - begin)
        alpha = np.zeros(n + 1)
        left = np.full(n + 1, -np.inf)  # left side of each character, within its chunk
        left[begin] = 0.0
        depth = stop - begin[chunk_of[stop - 1]]
        by_depth = np.argsort(depth, kind="stable")
        bounds = np.searchsorted(depth[by_depth], np.arange(1, int(depth.max()) + 2)) if len(depth) else np.zeros(1, int)
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            e = by_depth[lo:hi]
            if not len(e):
                continue
            value = left[start[e]] + weight[e]
            heads = np.flatnonzero(np.r_[True, stop[e][1:] != stop[e][:-1]])
            top = np.maximum.reduceat(value, heads)
            size = np.diff(np.r_[heads, len(e)])
            total = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, size)), heads))
            ends = stop[e][heads]
            alpha[ends] = total
            inner = ends[(ends < n)]
            inner = inner[chunk_of[np.minimum(inner, n - 1)] == chunk_of[inner - 1]]
            left[inner] = alpha[inner]
        share = np.exp(left[start] + weight - alpha[stop])
        heads = np.flatnonzero(np.r_[True, stop[1:] != stop[:-1]]) if len(stop) else np.zeros(0, int)
        # summed up end by end, so that no sum depends on what else is in the step
        within, size = share.copy(), np.diff(np.r_[heads, len(stop)]) if len(heads) else heads
        for k in range(1, int(size.max(initial=0))):
            more = heads[size > k] + k
            within[more] += within[more - 1]
        group_of = np.full(n + 1, -1, dtype=np.int64)
        group_of[stop[heads]] = np.arange(len(heads))
        last = np.r_[heads[1:], len(stop)] - 1 if len(heads) else heads
        return start, piece, within, heads, last, group_of

    def sample(self, codes: np.ndarray, row_start: np.ndarray, row_end: np.ndarray, keys: np.ndarray):
        """Pieces of rows laid end to end in ``codes``: ids of all rows, and their number per row."""
        if not len(codes):
            return np.zeros(0, np.int64), np.zeros(len(keys), np.int64)
        space = codes == MARK_CODE
        cut = space & ~np.r_[False, space[:-1]]
        cut[row_start[row_start < len(codes)]] = True
        begin = np.flatnonzero(cut)
        end = np.r_[begin[1:], len(codes)]
        h = code_hash(code_hash_sums(codes), begin, end)
        _, index, inverse = np.unique(h, return_index=True, return_inverse=True)
        d_begin, d_end = begin[index], end[index]
        size = d_end - d_begin
        base = np.cumsum(size) - size
        gather = np.arange(int(size.sum())) + np.repeat(d_begin - base, size)
        start, piece, within, heads, last, group_of = self.filtered(codes[gather], base, base + size)
        row = np.searchsorted(row_start, begin, side="right") - 1
        shift = begin - base[inverse]  # from a place in the distinct chunk to the place in codes
        at = base[inverse] + size[inverse]
        home = base[inverse]
        active = np.arange(len(begin))
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        while len(active):
            here = at[active]
            place = (here + shift[active] - row_start[row[active]]).astype(np.uint64)
            u = (mixed(keys[row[active]] + place * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)) * 2.0**-53
            g = group_of[here]
            pick = heads[g]
            stop = last[g]
            moving = np.flatnonzero((within[pick] <= u) & (pick < stop))
            while len(moving):
                pick[moving] += 1
                moving = moving[(within[pick[moving]] <= u[moving]) & (pick[moving] < stop[moving])]
            taken.append((active, pick))
            at[active] = start[pick]
            active = active[start[pick] > home[active]]
        number = np.zeros(len(begin), dtype=np.int64)
        for who, _ in taken:
            number[who] += 1
        place = np.cumsum(number) - 1
        out = np.empty(int(number.sum()), dtype=np.int64)
        for who, pick in taken:
            out[place[who]] = piece[pick]
            place[who] -= 1
        per_row = np.bincount(row, weights=number, minlength=len(keys)).astype(np.int64)
        return self.spell_out(out, per_row)

    def spell_out(self, ids: np.ndarray, per_row: np.ndarray):
        """Unknown characters become the ids of their bytes."""
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids, per_row
        spelled = [(MARK if c == LITERAL_MARK else chr(c)).encode() for c in (-1 - ids[odd]).tolist()]
        extra = np.ones(len(ids), dtype=np.int64)
        extra[odd] = [len(s) for s in spelled]
        to = np.cumsum(extra) - extra
        out = np.repeat(ids, extra)
        flat = np.frombuffer(b"".join(spelled), dtype=np.uint8)
        where = np.repeat(to[odd], extra[odd]) + np.arange(len(flat)) - np.repeat(np.cumsum(extra[odd]) - extra[odd], extra[odd])
        out[where] = self.byte_ids[flat]
        row = np.repeat(np.arange(len(per_row)), per_row)
        return out, np.bincount(row, weights=extra, minlength=len(per_row)).astype(np.int64)


class Speller:
    """What the pieces spell; without the tables that sampling needs, as it has a worker of its own."""

    def __init__(self, vocabulary: Vocabulary):
        texts = [p.replace(MARK, " ").encode() if ok else b"" for p, ok in zip(vocabulary.pieces, vocabulary.normal)]
        for b, i in enumerate(vocabulary.byte_ids):
            texts[i] = bytes([b])
        self.text_end = np.cumsum([len(t) for t in texts])
        self.text_start = self.text_end - np.array([len(t) for t in texts])
        self.text = np.frombuffer(b"".join(texts), dtype=np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        size = (self.text_end - self.text_start)[ids]
        base = np.cumsum(size) - size
        return self.text[np.arange(int(size.sum())) + np.repeat(self.text_start[ids] - base, size)].tobytes()


_spellers: dict[str, Speller] = {}
_samplers: dict[tuple[str, float], Sampler] = {}


def sampler(path: str, temperature: float) -> Sampler:
    if (path, temperature) not in _samplers:
        _samplers[path, temperature] = Sampler(load(path), temperature)
    return _samplers[path, temperature]


def row_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).copy()
    codes[codes == MARK_CODE] = LITERAL_MARK
    codes[codes == SPACE] = MARK_CODE
    size = np.array([len(t) for t in texts], dtype=np.int64)
    end = np.cumsum(size)
    return codes, end - size, end


def encode_sampled(
    docs: DataFrame,
    model_path: str,
    seed: int = 0,
    temperature: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Id, ``key``, ``text`` and ``ids``: one sampled segmentation of each whole text, seeded by the row's id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = sampler(model_path, temperature)
        for batch in batches:
            keys = mixed(np.asarray(batch.column(1)).astype(np.int64).view(np.uint64) + np.uint64(seed))
            size = np.asarray(pc.fill_null(pc.utf8_length(batch.column(2)), 0), dtype=np.int64)
            edges = np.flatnonzero(np.diff(np.cumsum(size) // STEP_CHARS)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(size)]):
                texts = batch.column(2)[lo:hi]
                codes, row_start, row_end = row_codes([t or "" for t in texts.to_pylist()])
                ids, per_row = of.sample(codes, row_start, row_end, keys[lo:hi])
                offsets = np.r_[0, np.cumsum(per_row)].astype(np.int32)
                arrays = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], texts, arrays], names=[id_col, "text", "ids"])

    kind = dict(docs.dtypes)[id_col]
    key = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    return docs.select(id_col, key.alias("key"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"`{id_col}` {kind}, text string, ids array<int>"
    )


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text that its ids spell."""

    @F.pandas_udf("string")
    def spell(x):
        import pandas as pd

        if model_path not in _spellers:
            _spellers[model_path] = Speller(load(model_path))
        of = _spellers[model_path]
        return pd.Series([of.decode(np.asarray(v, dtype=np.int64)).decode() for v in x])

    return encoded.withColumn(out_col, spell(ids_col))
