"""Periodic runs of words: every maximal stretch that repeats a period of words four times or more.

Scale-tiled: the periods fall into octaves, 2^k to 2^(k+1) - 1. A text of up to ``tile`` words is one tile
for all of them; a longer one is cut into overlapping tiles, some for all small octaves and some for each
larger octave, four times its scale long, which any task solves by itself. Within a tile there is a boundary
every 2^k words. The Z-values at a boundary say how far the words from it on agree with those q further on,
forwards and backwards; of a run with a period of the octave, at least two whole spaces between boundaries
agree, so boundaries whose first Z-value falls short are passed over, and neighbouring ones that do not are
one fragment. Fragments are dealt by document and period and stitched where they touch; a run cut by tiles
becomes whole again. Of equal stretches the smallest period is the run's.

Words are told apart within one document by a 64-bit hash, agreements by sums modulo two primes of 31 bits.

Defined cases: a null text and one without words have no words and no run; a text of one very long word is one
word. Rows with an equal id (null ids too) and an equal text are alike in all outputs, and worked out once where
they can be stitched together. An empty table gives an empty result. Other columns are left aside unless named in
``carry``; a carried one may have any name but those of the result. Ties of the highest exponent go to the smallest
start, then to the smallest period. A text of n words takes some 100 n bytes of a task; tiles of the highest octave
hold the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pantrylens.llm.shared import Words, mixed, saved, steps, text_bytes

#: Words of a tile that holds all small octaves; longer texts are cut.
TILE_WORDS = 16_384
#: Least words of a run, and least repeats of its period.
LEAST_WORDS, LEAST_REPEATS = 6, 4

_ROW = np.uint64(0xD6E8FEB86659FD93)
# Two primes below 2^31 and a base for each.
_PRIMES = (np.uint64(2147483647), np.uint64(2147483629))
_BASES = (np.uint64(1103515245), np.uint64(1812433253))
_powers: list[np.ndarray] = []

TILE_KIND = "struct<low: int, high: int, first: long, last: boolean, ids: binary>"
FRAGMENT = pa.struct([("period", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])
TILE = pa.struct([("low", pa.int32()), ("high", pa.int32()), ("first", pa.int64()), ("last", pa.bool_()), ("ids", pa.binary())])


def powers(n: int) -> list[np.ndarray]:
    """The bases to the powers 0 to n - 1, modulo their primes."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        made = []
        for prime, base in zip(_PRIMES, _BASES):
            out, filled, step = np.ones(size, dtype=np.uint64), 1, base % prime
            while filled < size:
                more = min(filled, size - filled)
                out[filled : filled + more] = out[:more] * step % prime
                filled, step = filled + more, step * step % prime
            made.append(out)
        _powers[:] = made
    return [p[:n] for p in _powers]


class Spans:
    """Compares spans of a sequence of codes in constant time."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        self.powers = powers(self.n + 1)
        self.sums = []
        for prime, power in zip(_PRIMES, self.powers):
            total = np.zeros(self.n + 1, dtype=np.uint64)
            np.cumsum(codes % prime * power[: self.n] % prime, out=total[1:])
            total %= prime
            self.sums.append(total)

    def blocks(self, size: int) -> np.ndarray:
        """A code for the ``size`` words from each position on; equal codes, equal words."""
        out = np.zeros(self.n - size + 1, dtype=np.uint64)
        for prime, power, total in zip(_PRIMES, self.powers, self.sums):
            span = (total[size:] + prime - total[: self.n - size + 1]) * power[self.n : size - 1 : -1] % prime
            out = out << np.uint64(32) | span
        return out

    def agree(self, left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the words from ``left`` on are those from ``right`` (further on) on."""
        ok = np.ones(len(left), dtype=bool)
        for prime, power, total in zip(_PRIMES, self.powers, self.sums):
            a = (total[left + length] + prime - total[left]) * power[right - left] % prime
            ok &= a == (total[right + length] + prime - total[right]) % prime
        return ok

    def reach(self, at: np.ndarray, period: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """Z-values: words from ``at`` on (or before it) that agree with those a period on, ``most`` at most."""
        low, high = np.zeros(len(at), dtype=np.int64), most.astype(np.int64)
        while (low < high).any():
            middle = (low + high + 1) // 2
            start = at - middle if back else at
            ok = self.agree(start, start + period, middle)
            low, high = np.where(ok, middle, low), np.where(ok, high, middle - 1)
        return low


def least_length(period):
    return np.maximum(LEAST_WORDS, LEAST_REPEATS * period)


def stretches(codes: np.ndarray, low: int, high: int, open_left: bool = False, open_right: bool = False):
    """period, start, stop: maximal stretches of positions whose word is that one period on.

    Only periods of the octaves from ``low`` to ``high``, and stretches long enough for a run, or that an
    open end may cut.
    """
    n, found = len(codes), []
    spans = Spans(codes)
    for octave in range(low, high + 1):
        size = 1 << octave
        if n < 2 * size:
            break
        code = spans.blocks(size)
        grid = np.full(-(-len(code) // size) * size, np.iinfo(np.uint64).max, dtype=np.uint64)
        grid[: len(code)] = code
        grid = grid.reshape(-1, size)
        hit = np.flatnonzero(grid[1:] == grid[:-1, :1])
        if not len(hit):
            continue
        boundary, period = hit // size, size + hit % size
        order = np.lexsort((boundary, period))
        boundary, period = boundary[order], period[order]
        head = np.ones(len(hit), dtype=bool)
        head[1:] = (period[1:] != period[:-1]) | (boundary[1:] != boundary[:-1] + 1)
        first = np.flatnonzero(head)
        period, start, stop = period[first], boundary[first] * size, (boundary[np.r_[first[1:], len(hit)] - 1] + 1) * size
        edge = (open_left & (start < size)) | (open_right & (stop + size > n - period))
        able = edge | (stop - start + 2 * (size - 1) + period >= least_length(period))
        period, start, stop = period[able], start[able], stop[able]
        start = start - spans.reach(start, period, np.minimum(size, start), True)
        stop = stop + spans.reach(stop, period, np.minimum(size, n - period - stop), False)
        edge = (open_left & (start == 0)) | (open_right & (stop == n - period))
        whole = edge | (stop - start + period >= least_length(period))
        found.append((period[whole], start[whole], stop[whole]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*found))


def top_octave(n: int) -> int:
    """The octave of the longest period that can be repeated often enough in ``n`` words; -1 for none."""
    return (n // LEAST_REPEATS).bit_length() - 1


def tiles_of(ids: np.ndarray, tile: int):
    """Tiles of a long text: the low and high octave, first word, whether it is the last, and its words."""
    n, top = len(ids), top_octave(len(ids))
    small = min(top, max(0, top_octave(tile // LEAST_REPEATS)))
    for low, high in [(0, small)] + [(k, k) for k in range(small + 1, top + 1)]:
        scale = 4 << high
        step = max(tile, scale)
        for first in range(0, n, step):
            end = min(n, first + step + scale)
            yield low, high, first, end == n, ids[first:end]
            if end == n:
                break


def spaced(w: Words) -> pa.Array:
    """Each row's words joined by one space."""
    keep = w.inside.copy()
    apart = np.flatnonzero(w.row[1:] == w.row[:-1])
    keep[w.end[:-1][apart]] = True
    sizes = w.row_sums(keep.astype(np.int64))
    data = np.where(w.inside, w.buf, 32).astype(np.uint8)[keep]
    ends = np.zeros(w.rows + 1, dtype=np.int64)
    np.cumsum(sizes, out=ends[1:])
    return pa.Array.from_buffers(pa.large_string(), w.rows, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])


def fragment_lists(rows: int, row: np.ndarray, period: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    order = np.argsort(row, kind="stable")
    values = pa.StructArray.from_arrays([pa.array(x[order]) for x in (period, start, stop)], fields=list(FRAGMENT))
    ends = np.zeros(rows + 1, dtype=np.int32)
    np.cumsum(np.bincount(row, minlength=rows), out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), values)


def read_words(docs: DataFrame, tile: int, text_col: str, carry: list[str]) -> DataFrame:
    """A row for each text with its fragments if it is one tile, and rows of tiles for each longer one."""
    names = [*carry, "key_a", "key_b", "n_words", "spaced", "fragments", "tiled", "tile"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, starts, ends = text_bytes(batch.column(0))
            for lo, hi in steps(starts, ends):
                w = Words(buf, starts[lo:hi], ends[lo:hi])
                plain = w.hashes()
                tiled = w.per_row > tile
                short = ~tiled[w.row]
                at, row = np.flatnonzero(short), w.row[short]
                codes = mixed(plain[short] + row.astype(np.uint64) * _ROW)
                longest = int(w.per_row[~tiled].max(initial=0))
                period, start, stop = stretches(codes, 0, top_octave(longest))
                of = row[start]
                base = w.first_word[of]
                lists = fragment_lists(w.rows, of, period, at[start] - base, at[stop - 1] + 1 - base)
                others = [batch.column(k)[lo:hi] for k in range(1, batch.num_columns)]
                columns = [*others, pa.array(w.per_row, pa.int64()), spaced(w).cast(pa.string()), lists, pa.array(tiled), pa.nulls(w.rows, TILE)]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                for r in np.flatnonzero(tiled).tolist():
                    ids = np.unique(plain[w.first_word[r] : w.first_word[r] + w.per_row[r]], return_inverse=True)[1].astype(np.int32)
                    for low, high, first, last, part in tiles_of(ids, tile):
                        one = [pa.nulls(1, c.type) for c in columns]
                        one[len(carry)], one[len(carry) + 1] = others[-2][r : r + 1], others[-1][r : r + 1]
                        one[-1] = pa.array([{"low": low, "high": high, "first": first, "last": last, "ids": part.tobytes()}], TILE)
                        yield pa.RecordBatch.from_arrays(one, names=names)

    text = F.col(text_col).cast("string")
    # 128 bits for the row: equal ids and texts are one and the same to the stitching
    kept = docs.select(text.alias("text"), *carry)
    keyed = kept.withColumns({"key_a": F.xxhash64("text", *carry), "key_b": F.xxhash64(F.lit(1), F.lit("b"), *carry, "text")})
    kinds = [f"`{c}` {kind}" for c, kind in kept.select(*carry).dtypes]
    return keyed.select("text", *carry, "key_a", "key_b").mapInArrow(
        run,
        ", ".join([*kinds, "key_a long, key_b long, n_words long, spaced string"])
        + f", fragments array<struct<period: long, start: long, stop: long>>, tiled boolean, tile {TILE_KIND}",
    )


def solved(tiles: DataFrame) -> DataFrame:
    """Fragments of each tile, in words of its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                tile = batch.column(2)[r].as_py()
                codes = mixed(np.frombuffer(tile["ids"], dtype=np.int32).astype(np.uint64) + _ROW)
                first = tile["first"]
                period, start, stop = stretches(codes, tile["low"], tile["high"], first > 0, not tile["last"])
                n = len(period)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(batch.column(0)[r], n), pa.repeat(batch.column(1)[r], n), pa.array(period), pa.array(start + first), pa.array(stop + first)],
                    names=["key_a", "key_b", "period", "start", "stop"],
                )

    dealt = tiles.repartition("key_a", "key_b", "tile.low", "tile.first")
    return dealt.select("key_a", "key_b", "tile").mapInArrow(run, "key_a long, key_b long, period long, start long, stop long")


def stitched(fragments: DataFrame) -> DataFrame:
    """Runs from fragments: touching ones of a document and period are one; of equal stretches the smallest period stays."""
    by_start = Window.partitionBy("key_a", "key_b", "period").orderBy("start", "stop")
    before = F.max("stop").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0)
    island = F.sum("apart").over(by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = fragments.distinct().withColumn("apart", apart).withColumn("island", island)
    whole = joined.groupBy("key_a", "key_b", "period", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    length = F.col("stop") - F.col("start") + F.col("period")
    long = whole.withColumn("length", length).where(F.col("length") >= F.greatest(F.lit(LEAST_WORDS), LEAST_REPEATS * F.col("period")))
    return long.groupBy("key_a", "key_b", "start", "length").agg(F.min("period").alias("period"))


def collapsed(rows: DataFrame, carry: list[str]) -> DataFrame:
    """Texts without the words that a run holds after its first period."""
    names = [*carry, "n_words", "runs", "collapsed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, text, runs in zip(*(batch.column(c).to_pylist() for c in ("n_words", "spaced", "runs"))):
                edge = np.zeros(n + 1, dtype=np.int64)
                for x in runs:
                    edge[x["start"] + x["period"]] += 1
                    edge[x["start"] + x["length"]] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                words = text.split(" ")
                out.append(" ".join([words[i] for i in np.flatnonzero(~gone).tolist()]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.array(out, pa.string())], names=names)

    kinds = ", ".join(f"`{c}` {kind}" for c, kind in rows.select(*carry, "n_words", "runs").dtypes)
    return rows.select(*carry, "n_words", "spaced", "runs").mapInArrow(run, f"{kinds}, collapsed string")


def periodic_runs(docs: DataFrame, tile: int = TILE_WORDS, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, n_words, runs (start, period, length, by start and period) and the collapsed text of each row."""
    carry = list(carry)
    pieces = saved(read_words(docs, tile, text_col, carry), "word-tiles", compression="zstd")
    texts = pieces.where("tile is null")
    at_once = texts.where("size(fragments) > 0").select("key_a", "key_b", F.explode("fragments").alias("f")).select("key_a", "key_b", "f.*")
    fragments = at_once.union(solved(pieces.where("tile is not null")))
    run = F.struct("start", "period", "length")
    runs = stitched(fragments).groupBy("key_a", "key_b").agg(F.sort_array(F.collect_list(run)).alias("runs"))
    hit = F.col("tiled") | (F.size("fragments") > 0)
    found = texts.where(hit).join(runs, ["key_a", "key_b"], "left")
    found = found.withColumn("runs", F.coalesce("runs", F.array().cast("array<struct<start: long, period: long, length: long>>")))
    none = F.array().cast("array<struct<start: long, period: long, length: long>>").alias("runs")
    rest = texts.where(~hit).select(*carry, "n_words", none, F.col("spaced").alias("collapsed"))
    return rest.union(collapsed(found, carry))


def most_repeated(runs: Column) -> Column:
    """Of runs by start and period, the first of the greatest length / period; null for none. Compared as whole numbers."""
    more = lambda best, x: best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"])
    return F.aggregate(runs, F.lit(None).cast("struct<start: long, period: long, length: long>"), lambda best, x: F.when(more(best, x), x).otherwise(best))


def with_planted_run(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text of one document in ten made periodic from some word on, told by the id's crc32.

    With h the crc32 and g = h // 10: where 10 divides h, of n words those from a = g % n on repeat the first
    1 + (n - a) // (3 + g % 8) of them. Rows with a null id or without words stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.filter(F.split(F.col(text_col), "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    # one step a column, so that none is worked out again for each word
    split = docs.withColumns({"run_words": F.when(h % 10 == 0, words), "run_g": F.floor(h / 10)})
    started = split.withColumn("run_a", (F.col("run_g") % F.nullif(F.size("run_words"), F.lit(0))).cast("int"))
    a = F.col("run_a")
    placed = started.withColumn("run_p", (1 + F.floor((F.size("run_words") - a) / (3 + F.col("run_g") % 8))).cast("int"))
    planted = F.transform("run_words", lambda x, i: F.when(i < a, x).otherwise(F.get(F.col("run_words"), a + (i - a) % F.col("run_p"))))
    chosen = F.size("run_words") > 0
    return placed.select(*[F.when(chosen, F.array_join(planted, " ")).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c) for c in docs.columns])
