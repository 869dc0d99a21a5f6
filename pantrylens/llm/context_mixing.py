"""Language-model scoring by logistic mixing of hashed-context bit predictors.

A text is its kind, then its lower-cased words, each spelled as its bytes and a space, then an end
byte. Its kind is its most frequent word, hashed to one of KINDS, and costs the log of its share.
Every bit is predicted from counts of zeros and ones in several contexts: the last one, two and three
bytes of the text (fixed hashed tables), which reach over the space into the word before, and the word so far,
with and without the kind (tables that grow with the corpus). The predictions, stretched to log-odds, are summed by weights; a gate chooses the set of
weights by how often the word so far has been seen. An adaptive probability map, by gate and log-odds,
refines the result.

The bits of a word's first OPENING bytes depend on its kind, these bytes and the REACH last bytes before its
space; those of the others on the kind and the word alone. So the model works on two tables of distinct values
and their counts: openings, and words, which are distributed by their first bytes and spelled some at a time, with
what their beginnings count in the rest of their group. Learning is online: each event
is predicted from counts without it, the weights then move by its error. Shards start from equal
weights, and their results are averaged by the events they saw.

Texts are scored from a broadcast table of the most frequent words and openings (of a fixed size at most) and a
join for all others. A text begins as after two zero bytes and a space.

Defined cases: a null or empty text is the end alone. A null id counts as training text. Repeated
rows are learned from and scored each. With no training text the model is that of empty counts.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pantrylens.llm.shared import mixed, prefix_sums, saved, span_hash

END = b"\n"
KINDS = 16
#: Slots of the hashed tables: last byte, last two and last three with the kind, and the start of the word (up to
#: SHARD_PREFIX bytes) without and with the kind.
TABLE_BITS = (14, 17, 18, 18, 19)
WITH_KIND = (False, True, True, False, True)
SHARD_PREFIX = 4
#: Bytes of a word whose contexts reach into the word before, and how far before the space they reach.
OPENING, REACH = 2, 2
#: Words and openings held in every task while texts are scored; the others are joined.
FREQUENT_WORDS = 1 << 18
#: Distinct words of an online step, bits that it has at most, slices in which table counts are summed.
BATCH_WORDS, MOST_BITS, SLICES = 8_000, 2_000_000, 32
#: Bytes of words that are spelled at once, each to eight bits with some 300 bytes of arrays, and of a word to be cut for it.
SPELLED_BYTES, LONG_WORD = 16_000, 1_000
#: Sets of weights: by how often the word so far was seen and whether its next bit was always the same; those from
#: SHORT on are for the first SHARD_PREFIX bytes, whose weights stay as they start, as a shard has few of their words;
#: those from 2 * SHORT on are for openings, which have weights of their own, learned from their table.
GATES, SHORT, LEVELS = 96, 32, 33
INPUTS = len(TABLE_BITS)  # last bytes, the word so far without and with the kind


@dataclass
class Spelled:
    """All bits of some words: a column for each byte, a row for each of its bits."""

    word: np.ndarray  # of each byte, its word
    place: np.ndarray  # and place in it
    bit: np.ndarray
    slots: list[np.ndarray]  # of each table
    prefix: np.ndarray  # key of the word so far and the bits so far
    prefix_kind: np.ndarray  # and of these with the kind


def spell(words: list[bytes], kinds: np.ndarray, reach: list[bytes] | None = None, first: int = 0, stop: int | None = None) -> Spelled:
    """Bits of the bytes ``first`` to ``stop`` of words that follow ``reach`` (REACH bytes; none: a text's start) and a space."""
    texts = [w if w == END else w + b" " for w in words]
    back = REACH + 1
    size = np.array([len(t) for t in texts], dtype=np.int64)
    before = reach or [bytes(REACH)] * len(words)
    buf = np.frombuffer(b"".join([r + b" " + t for r, t in zip(before, texts)]), dtype=np.uint8)
    begin = np.cumsum(size + back) - size
    kept = np.minimum(size, size if stop is None else stop)
    count = np.maximum(kept - first, 0)
    word = np.repeat(np.arange(len(texts)), count)
    place = first + np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
    at = begin[word] + place
    value = buf[at].astype(np.uint64)
    last = [buf[at - k].astype(np.uint64) for k in (1, 2, 3)]
    so_far = span_hash(prefix_sums(buf), begin[word], at) + np.minimum(place, 255).astype(np.uint64)
    orders = [last[0], last[0] | last[1] << np.uint64(8), last[0] | last[1] << np.uint64(8) | last[2] << np.uint64(16)]
    orders += [so_far, so_far]
    kind = (kinds.astype(np.uint64) + np.uint64(1))[word] * np.uint64(0xE7037ED1A0B428DB)
    nodes = np.stack([(np.uint64(1) << np.uint64(j)) | (value >> np.uint64(8 - j)) for j in range(8)])
    bit = np.stack([(value >> np.uint64(7 - j)) & np.uint64(1) for j in range(8)]).astype(np.float32)
    slots = []
    for k, (context, bits, kinded) in enumerate(zip(orders, TABLE_BITS, WITH_KIND)):
        key = mixed(context * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1) + (kind if kinded else np.uint64(0)))
        slot = mixed(key[None, :] + nodes * np.uint64(0xD1B54A32D192ED03))
        slots.append((slot & np.uint64((1 << bits) - 1)).astype(np.int64))
    prefix = so_far[None, :] + nodes * np.uint64(0xA0761D6478BD642F)
    return Spelled(word, place, bit, slots, prefix, prefix + mixed(kind))


def spell_rest(words: list[bytes], kinds: np.ndarray) -> Spelled:
    """Bits of words without their openings; three bytes back lead to the space at most."""
    return spell(words, kinds, None, OPENING)


def spell_openings(openings: list[bytes], kinds: np.ndarray) -> Spelled:
    return spell([x[REACH:] for x in openings], kinds, [x[:REACH] for x in openings], 0, OPENING)


def openings_of(words: list[bytes]) -> list[bytes]:
    """Of each word of a text, the REACH bytes before its space and its first OPENING bytes (one where it has no more)."""
    ends = [bytes(REACH), *[w[-REACH:] if len(w) >= REACH else b" " + w for w in words[:-1]]]
    return [a + w[:OPENING] for a, w in zip(ends, words)]


def table_counts(words: DataFrame) -> list[np.ndarray]:
    """For each hashed table, zeros and ones seen in each slot over all training words and openings (fixed size)."""
    ends = np.cumsum([0, *(2 << b for b in TABLE_BITS)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(ends[-1], dtype=np.float64)
        for batch in batches:
            for opens, spelled in ((False, spell_rest), (True, spell_openings)):
                some = batch.filter(pc.equal(batch.column(3), opens)).select([0, 2, 1])
                for part in parts(some):
                    for s in part.spelled(spelled):
                        weight = np.broadcast_to(part.c[s.word], s.bit.shape).ravel()
                        for k, slot in enumerate(s.slots):
                            np.add.at(sums[ends[k] : ends[k + 1]], (2 * slot + s.bit.astype(np.int64)).ravel(), weight)
        if sums.any():
            cuts = np.array_split(sums, SLICES)
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([c.tobytes() for c in cuts], pa.binary())], names=["slice", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, dtype=np.float64) for b in table["sums"].to_pylist())
        return pa.table({"slice": table["slice"][:1], "sums": pa.array([total.tobytes()], pa.binary())})

    counted = words.where("c > 0").select("word", "c", "kind", "opens").mapInArrow(count, "slice int, sums binary")
    rows = counted.groupBy("slice").applyInArrow(add, "slice int, sums binary").orderBy("slice").collect()
    flat = np.concatenate([np.frombuffer(r["sums"], dtype=np.float64) for r in rows]) if rows else np.zeros(ends[-1])
    return [flat[a:b].reshape(-1, 2) for a, b in zip(ends[:-1], ends[1:])]


def stretched(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log-odds of a one, drawn to 0 where little has been seen."""
    n = zeros + ones
    return (np.log((ones + 0.02) / (zeros + 0.02)) * (n / (n + 0.4))).astype(np.float32)


def features(
    s: Spelled, c: np.ndarray, tables: list[np.ndarray], without_own: bool, whole: list[tuple[np.ndarray, ...]] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Inputs (bits x INPUTS) and gate of every bit, in the order of the words.

    ``whole`` has the counts of the words so far that go on in other parts, without and with the kind: keys in order, all, ones.
    """
    weight = c[s.word]
    bit = s.bit.astype(np.float64)
    own = (np.broadcast_to(weight > 0, bit.shape) if without_own else np.zeros_like(bit)).astype(np.float64)
    own_zero, own_one = own * (1 - bit), own * bit
    x = np.empty((*bit.shape, INPUTS), dtype=np.float32)
    seen = None
    # the word so far: a shard holds all words with its first bytes, the fixed tables have what is shorter
    short = (s.place < SHARD_PREFIX)[None, :]
    weights = np.broadcast_to(weight, bit.shape).ravel()
    for k, (slot, table) in enumerate(zip(s.slots, tables)):
        zeros, ones = table[slot, 0] - own_zero, table[slot, 1] - own_one
        if k >= 3:
            keys, group = np.unique(s.prefix if k == 3 else s.prefix_kind, return_inverse=True)
            group = group.reshape(bit.shape)
            total = np.bincount(group.ravel(), weights=weights)
            positive = np.bincount(group.ravel(), weights=weights * bit.ravel())
            if whole is not None and len(keys):
                known, of_all, of_ones = whole[k - 3]
                at = np.minimum(np.searchsorted(keys, known), len(keys) - 1)
                here = keys[at] == known
                total[at[here]], positive[at[here]] = of_all[here], of_ones[here]
            total, positive = total[group], positive[group]
            ones = np.where(short, ones, positive - own_one)
            zeros = np.where(short, zeros, total - positive - own_zero)
        ones, zeros = np.maximum(ones, 0), np.maximum(zeros, 0)
        x[:, :, k] = stretched(zeros, ones)
        if k == 4:
            seen = np.minimum(np.log2(1 + zeros + ones), 15).astype(np.int64)
            sure = (np.minimum(zeros, ones) == 0).astype(np.int64)
    return x, 2 * seen + sure + SHORT * short + SHORT * (s.place < OPENING)[None, :]


def first_weights() -> np.ndarray:
    trust = np.clip((np.arange(GATES) % SHORT // 2) / 6, 0, 1)[:, None]
    return trust * np.array([[0.0, 0.0, 0.1, 0.2, 0.7]]) + (1 - trust) * np.array([[0.1, 0.2, 0.3, 0.3, 0.1]])


def level(st: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(st * 2) + LEVELS // 2, 0, LEVELS - 1).astype(np.int64)


@dataclass
class Model:
    tables: list[np.ndarray]
    weights: np.ndarray
    refined: np.ndarray  # by gate and level, what to add to the log-odds

    def log10(self, part: Part, spelled: Callable = spell_rest) -> np.ndarray:
        """Log10 probability of each word after its opening, or of each opening by ``spell_openings``."""
        out = np.zeros(len(part.words))
        for s in part.spelled(spelled):
            x, gate = features(s, part.c, self.tables, False, part.whole)
            st = np.einsum("bni,bni->bn", x, self.weights[gate].astype(np.float32)).astype(np.float64)
            st = np.clip(st + self.refined[gate, level(st)], -14, 14)
            bits = -np.logaddexp(0, np.where(s.bit > 0, -st, st)).sum(axis=0)
            out += np.bincount(s.word, weights=bits, minlength=len(out))
        return out / math.log(10)


def sharded(words: DataFrame) -> DataFrame:
    """Words (no openings) with equal first bytes in one partition, side by side and in the order of their spelling."""
    first = F.substring("word", 1, SHARD_PREFIX)
    rows = words.where("not opens").select("word", "kind", "c", first.alias("first"))
    return rows.repartition("first").sortWithinPartitions("first", F.concat("word", F.lit(b" ")))


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """word, kind, c, first: some groups of equal first bytes at a time, never a part of a group; as columns they take little."""
    held: list[pa.RecordBatch] = []
    n, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        first = batch.column(3)
        new = [0] if first[0].as_py() != last else []
        new += (np.flatnonzero(np.asarray(pc.not_equal(first[1:], first[:-1]))) + 1).tolist()
        lo = 0
        for at in new:
            if n + at - lo >= BATCH_WORDS:
                held.append(batch.slice(lo, at - lo))
                yield pa.Table.from_batches(held)
                held, n, lo = [], 0, at
        held.append(batch.slice(lo))
        n += batch.num_rows - lo
        last = first[-1].as_py()
    if n:
        yield pa.Table.from_batches(held)


@dataclass
class Part:
    """Some words that are spelled at once, with all rows of each, and what other parts count for them."""

    words: list[bytes]
    kinds: np.ndarray
    c: np.ndarray
    whole: list[tuple[np.ndarray, ...]] | None = None

    def spelled(self, spelled: Callable) -> Iterator[Spelled]:
        """Bits of the words; of words that are too long for one step, some places at a time, which share no context's count."""
        longest = max(len(w) for w in self.words)
        if spelled is spell_openings or longest * len(self.words) <= SPELLED_BYTES or longest <= LONG_WORD:
            yield spelled(self.words, self.kinds)
            return
        span = max(LONG_WORD, SPELLED_BYTES // len(self.words))
        for first in range(OPENING, longest + 1, span):
            yield spell(self.words, self.kinds, None, first, first + span)


def parts(rows: pa.Table | pa.RecordBatch) -> Iterator[Part]:
    """word, kind and c in parts of SPELLED_BYTES or one word; the rows of a word stay together where they follow each other."""
    n = rows.num_rows
    words = pa.chunked_array(rows.column(0)) if isinstance(rows, pa.Table) else pa.chunked_array([rows.column(0)])
    size = np.asarray(pc.binary_length(words)).astype(np.int64) + 1
    upto = np.cumsum(size)
    lo = 0
    while lo < n:
        hi = max(int(np.searchsorted(upto, upto[lo] - size[lo] + SPELLED_BYTES, side="right")), lo + 1)
        while hi < n and words[hi] == words[hi - 1]:
            hi += 1
        some = rows.slice(lo, hi - lo)
        yield Part(some.column(0).to_pylist(), np.asarray(some.column(1)).astype(np.int64), np.asarray(some.column(2)).astype(np.float64))
        lo = hi


class Path:
    """The words of one group that begin as one word does, longer and longer, and their counts by kind and next byte."""

    def __init__(self, rows: pa.Table):
        words = rows.column(0).combine_chunks()
        self.data = np.frombuffer(words.buffers()[2], dtype=np.uint8)
        at = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        self.start, self.size = at[:-1], np.diff(at)
        self.kinds, self.c = np.asarray(rows.column(1)).astype(np.int64), np.asarray(rows.column(2)).astype(np.float64)
        self.word = b""
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # from SHARD_PREFIX on

    def next_bytes(self, rows: np.ndarray, place: int) -> np.ndarray:
        at = np.minimum(self.start[rows] + place, len(self.data) - 1)
        return np.where(place < self.size[rows], self.data[at], 32)

    def level(self, rows: np.ndarray, place: int) -> tuple[np.ndarray, np.ndarray]:
        cell = self.kinds[rows] * 256 + self.next_bytes(rows, place)
        return rows, np.bincount(cell, weights=self.c[rows], minlength=KINDS * 256).reshape(KINDS, 256)

    def counts(self, word: bytes, stop: int) -> list[tuple[np.ndarray, ...]]:
        """Keys, all and ones of the word so far at the places SHARD_PREFIX to ``stop``, without and with each kind."""
        text = word + b" "
        same = SHARD_PREFIX
        while same < min(len(text), len(self.word)) and text[same] == self.word[same]:
            same += 1
        del self.levels[max(same - SHARD_PREFIX, 0) + 1 :]
        self.word = text
        if not self.levels:
            self.levels.append(self.level(np.arange(len(self.c)), SHARD_PREFIX))
        for place in range(SHARD_PREFIX + len(self.levels), stop + 1):
            rows, _ = self.levels[-1]
            self.levels.append(self.level(rows[self.next_bytes(rows, place - 1) == text[place - 1]], place))
        found: list[list[tuple[np.ndarray, ...]]] = [[], []]
        for begin in range(SHARD_PREFIX, stop + 1, LONG_WORD):
            end = min(begin + LONG_WORD, stop + 1)
            cells = []
            for place in range(begin, end):
                by_byte = self.levels[place - SHARD_PREFIX][1]
                for j in range(8):
                    lo = text[place] >> (8 - j) << (8 - j)
                    cells.append((by_byte[:, lo : lo + (256 >> j)].sum(axis=1), by_byte[:, lo + (128 >> j) : lo + (256 >> j)].sum(axis=1)))
            s = spell([word] * KINDS, np.arange(KINDS), None, begin, end)
            by_kind = lambda keys: keys.reshape(8, KINDS, -1).transpose(2, 0, 1).reshape(-1, KINDS)
            both = np.array(cells)
            of_all, of_ones = both[:, 0], both[:, 1]
            seen = of_all > 0
            found[0].append((by_kind(s.prefix)[:, 0], of_all.sum(axis=1), of_ones.sum(axis=1)))
            found[1].append((by_kind(s.prefix_kind)[seen], of_all[seen], of_ones[seen]))
        return [tuple(np.concatenate(x) for x in zip(*f)) for f in found]


def shared_bytes(a: bytes, b: bytes) -> int:
    """The first place at which two different words, each with a space after it, differ."""
    a, b = a + b" ", b + b" "
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    return lo


def group_parts(rows: pa.Table) -> Iterator[Part]:
    """Parts of whole groups in the order of their spelling, with the counts of all words so far that go on in another part.

    Words that begin alike, to any bit, follow each other: what goes on is on the way to the words at both ends of a part.
    """
    path, n = None, 0
    before: list[tuple[np.ndarray, ...]] | None = None
    first = rows.column(0)
    for part in parts(rows):
        n += len(part.words)
        after = None
        if n < rows.num_rows:
            last, following = part.words[-1], first[n].as_py()
            stop = shared_bytes(last, following)
            if stop >= SHARD_PREFIX and last[:SHARD_PREFIX] == following[:SHARD_PREFIX]:
                if path is None or path[0] != last[:SHARD_PREFIX]:
                    of_group = rows.filter(pc.equal(rows.column(3), last[:SHARD_PREFIX]))
                    path = (last[:SHARD_PREFIX], Path(of_group))
                after = path[1].counts(last, stop)
        ends = [x for x in (before, after) if x is not None]
        if ends:
            part.whole = []
            for k in (0, 1):
                keys, one = np.unique(np.concatenate([x[k][0] for x in ends]), return_index=True)
                part.whole.append((keys, *(np.concatenate([x[k][i] for x in ends])[one] for i in (1, 2))))
        yield part
        before = after


def openings(words: DataFrame) -> DataFrame:
    """Openings, one by one: their counts are all in the fixed tables."""
    return words.where("opens").select("word", "kind", "c", F.col("word").alias("first"))


def learned(words: DataFrame, tables: list[np.ndarray], passes: int = 3) -> Model:
    """Weights by online steps within shards, averaged; the probability map from the same predictions."""
    shared = words.sparkSession.sparkContext.broadcast(tables)
    cells = GATES * LEVELS
    results = ("w", "mass", "hits", "tries", "sums")

    def learn(batches: Iterator[pa.RecordBatch], spelled: Callable, parts_of: Callable, live_of: Callable) -> Iterator[pa.RecordBatch]:
        w = first_weights()
        mass = np.zeros(GATES)
        hits, tries, sums = np.zeros(cells), np.zeros(cells), np.zeros(cells)

        def stepped(step: list[tuple[np.ndarray, ...]]) -> None:
            """One online step: all its parts are predicted with the same weights, which then move, once a pass."""
            for _ in range(passes):
                used = w.copy()
                gain, bend = np.zeros((INPUTS, GATES)), np.zeros((INPUTS, GATES))
                for x, g, b, m in step:
                    p = 1 / (1 + np.exp(-np.clip((x * used[g]).sum(axis=1), -14, 14)))
                    error, curve = (b - p) * m, p * (1 - p) * m
                    for i in range(INPUTS):
                        gain[i] += np.bincount(g, weights=error * x[:, i], minlength=GATES)
                        bend[i] += np.bincount(g, weights=curve * x[:, i] ** 2, minlength=GATES)
                w[:] = np.clip(w + (gain / (INPUTS * bend + 200)).T, -0.5, 1.5)
            for x, g, b, m in step:  # as the last pass has predicted them
                st = np.clip((x * used[g]).sum(axis=1), -14, 14)
                cell = g.astype(np.int64) * LEVELS + level(st)
                for into, of in ((tries, m), (hits, m * b), (sums, m * st)):
                    into += np.bincount(cell, weights=of, minlength=cells)
                mass[:] += np.bincount(g, weights=m, minlength=GATES)

        for rows in groups(batches):
            step, n = [], 0
            for part in parts_of(rows):
                for s in part.spelled(spelled):
                    live = np.flatnonzero(((part.c[s.word] > 0) & live_of(s.place))[None, :].repeat(8, axis=0).ravel())
                    if not len(live):
                        continue
                    x, gate = features(s, part.c, shared.value, True, part.whole)
                    m = part.c[s.word][live % len(s.word)]
                    step.append((x.reshape(-1, INPUTS)[live], gate.ravel()[live].astype(np.int16), s.bit.ravel()[live].astype(bool), m))
                    n += len(live)
                    if n >= MOST_BITS:  # a group of very many words takes several steps
                        stepped(step)
                        step, n = [], 0
            if step:
                stepped(step)
        if mass.any():
            found = (w * mass[:, None], mass, hits, tries, sums)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([f.tobytes()], pa.binary()) for f in found), pa.array([TaskContext.get().partitionId() % 64], pa.int32())],
                names=[*results, "part"],
            )

    def add(table: pa.Table) -> pa.Table:
        total = {n: sum(np.frombuffer(b, dtype=np.float64) for b in table[n].to_pylist()) for n in results}
        return pa.table({n: pa.array([v.tobytes()], pa.binary()) for n, v in total.items()})

    fields = ", ".join(f"{n} binary" for n in results)
    some = words.where("c > 0")
    rest = sharded(some).mapInArrow(lambda x: learn(x, spell_rest, group_parts, lambda place: place >= SHARD_PREFIX), fields + ", part int")
    opened = openings(some).mapInArrow(lambda x: learn(x, spell_openings, parts, lambda place: place < OPENING), fields + ", part int")
    rows = rest.unionByName(opened).groupBy("part").applyInArrow(add, fields).collect()
    weights, refined = first_weights(), np.zeros(cells)
    if rows:  # 64 at most
        w, mass, hits, tries, sums = (sum(np.frombuffer(r[n], dtype=np.float64) for r in rows) for n in results)
        some = mass > 0
        weights[some] = w.reshape(GATES, INPUTS)[some] / mass[some, None]
        # what a cell's events show against what was predicted on average, drawn to no change where there are few
        mean = sums / np.maximum(tries, 1e-9)
        prior = 1 / (1 + np.exp(-mean))
        p = (hits + 50 * prior) / (tries + 50)
        refined = 0.5 * (np.log(p / (1 - p)) - mean)
    return Model(tables, weights, refined.reshape(GATES, LEVELS))


def kind_of(found: Counter) -> int:
    """The hash of a text's most frequent word, of equally frequent ones the smallest; 0 without a word."""
    if not found:
        return 0
    most = max(found.values())
    return zlib.crc32(min(w for w, n in found.items() if n == most)) % KINDS


def word_counts(docs: DataFrame, training: Column, text_col: str) -> DataFrame:
    """word, kind, opens, c: every distinct token and opening by kind of text, and how often training texts have it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            learn = [(Counter(), Counter()) for _ in range(KINDS)]
            other: list[tuple[set[bytes], set[bytes]]] = [(set(), set()) for _ in range(KINDS)]
            for text, use in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = (text or "").encode().lower().split()
                found = Counter(words)
                kind = kind_of(found)
                words.append(END)
                for into, of in zip((learn if use else other)[kind], (words, openings_of(words))):
                    into.update(of)
            for kind in range(KINDS):
                for opens in (False, True):
                    seen, more = learn[kind][opens], other[kind][opens]
                    rows = [*seen.items(), *((w, 0) for w in more if w not in seen)]
                    for k in range(0, len(rows), 20_000):
                        some = rows[k : k + 20_000]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([r[0] for r in some], pa.binary()), pa.array([kind] * len(some), pa.int32()), pa.array([opens] * len(some)), pa.array([r[1] for r in some], pa.int64())],
                            names=["word", "kind", "opens", "c"],
                        )

    counted = docs.select(F.col(text_col).cast("string"), training).mapInArrow(count, "word binary, kind int, opens boolean, c long")
    return counted.groupBy("word", "kind", "opens").agg(F.sum("c").alias("c"))


class Frequent:
    """Count, score and base of the most frequent words and openings: columns on the way, tables by kind in a task."""

    def __init__(self, rows: pa.Table, floor: float):
        self.rows, self.floor = rows, floor

    @cached_property
    def tables(self) -> list[tuple[dict, dict]]:
        out: list[tuple[dict, dict]] = [({}, {}) for _ in range(KINDS)]
        for batch in self.rows.to_batches(20_000):
            for word, kind, opens, c, p in zip(*(batch.column(k).to_pylist() for k in range(5))):
                out[kind][opens][word] = (c, p, math.log10((c + 0.1) / self.floor))
        return out


def most_frequent(costs: DataFrame) -> DataFrame:
    """word, kind, opens, c, p of the rows whose own count is so large that FREQUENT_WORDS have it at most.

    A limit would bring as many rows of every partition to the driver. Rows of one count stay or go together.
    """
    by_count = costs.groupBy("own").agg(F.count("*").alias("n"))  # as many rows as there are different counts
    upto = by_count.select("own", F.sum("n").over(Window.orderBy(F.desc("own"))).alias("upto"))
    least = upto.where(F.col("upto") <= FREQUENT_WORDS).agg(F.min("own")).first()[0]
    kept = F.lit(False) if least is None else F.col("own") >= least
    return costs.where(kept).select("word", "kind", "opens", "c", "p")


def score_texts(
    docs: DataFrame,
    held_out: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of each text."""
    spark = docs.sparkSession
    words = saved(word_counts(docs, ~held_out, text_col), "words")
    model = spark.sparkContext.broadcast(learned(words, table_counts(words)))
    ends = {r["kind"]: r["c"] for r in words.where((F.col("word") == F.lit(END)) & ~F.col("opens")).select("kind", "c").collect()}  # KINDS rows at most
    texts = sum(ends.values())
    prior = {k: math.log10((ends.get(k, 0) + 1) / (texts + KINDS)) for k in range(KINDS)}

    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for rows in groups(batches) for x in group_parts(rows)):
            names, kinds, c = part.words, part.kinds, part.c
            # a word's count over all kinds; the first of its rows, which follow each other, stands for it
            heads = np.array([True, *(a != b for a, b in zip(names, names[1:]))])
            of = np.cumsum(heads) - 1
            total = np.bincount(of, weights=c)[of].astype(np.int64)
            p = model.value.log10(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.binary()), pa.array(kinds.astype(np.int32)), pa.array(np.zeros(len(names), dtype=bool)), pa.array(c.astype(np.int64)), pa.array(total), pa.array(heads), pa.array(p)],
                names=scored,
            )

    def cost_openings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in parts(batch)):
            names, kinds, c = part.words, part.kinds, part.c
            own = pa.array(c.astype(np.int64))
            yes, no = (pa.array(np.full(len(names), x)) for x in (True, False))
            p = model.value.log10(part, spell_openings)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(kinds.astype(np.int32)), yes, own, own, no, pa.array(p)], names=scored)

    scored = ["word", "kind", "opens", "own", "c", "head", "p"]
    fields = "word binary, kind int, opens boolean, own long, c long, head boolean, p double"
    costs = saved(sharded(words).mapInArrow(cost, fields).unionByName(openings(words).mapInArrow(cost_openings, fields)), "word-scores")
    sums = costs.where("head").agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    n_train, n_words = sums["n"] or 0, sums["v"]
    floor = n_train + 0.1 * (n_words + 1)
    known = spark.sparkContext.broadcast(Frequent(most_frequent(costs).toArrow(), floor))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                out: list[tuple] = []
                rare: list[list[dict]] = []
                for text in part.column(2).to_pylist():
                    data = (text or "").encode()
                    words = data.lower().split()
                    found = Counter(words)
                    kind = kind_of(found)
                    table, opened = known.value.tables[kind]
                    words.append(END)
                    found[END] += 1
                    tokens = seen = 0
                    base, score = 0.0, prior[kind]
                    left = []
                    for word, n in found.items():
                        tokens += n
                        has = table.get(word)
                        if has is None:
                            left.append({"word": word, "n": n, "opens": False})
                        else:
                            seen += n if has[0] else 0
                            score += n * has[1]
                            base += n * has[2]
                    for opening, n in Counter(openings_of(words)).items():
                        has = opened.get(opening)
                        if has is None:
                            left.append({"word": opening, "n": n, "opens": True})
                        else:
                            score += n * has[1]
                    out.append((row, kind, tokens, seen, base, score, len(data) + 1))
                    rare.append(left)
                    row += 1
                numbers = [pa.array([o[k] for o in out], pa.float64() if k in (4, 5) else pa.int64()) for k in range(7)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *numbers, pa.array(rare, RARE)], names=names)

    names = [id_col, "held_out", "row", "kind", "n_tokens", "n_known", "base_score", "score", "n_bytes", "rare"]
    of_id = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {of_id}, held_out boolean, row long, kind long, n_tokens long, n_known long, base_score double, score double, n_bytes long, rare array<struct<word: binary, n: long, opens: boolean>>"
    # Written once, so that the row numbers stay what they are.
    rows = saved(docs.select(id_col, held_out.alias("held_out"), F.col(text_col).cast("string").alias("text")).mapInArrow(measure, schema), "text-scores")
    base, token = F.log10((F.col("c") + 0.1) / F.lit(floor)), ~F.col("opens")
    more = (
        rows.select("row", F.col("kind").cast("int").alias("kind"), F.inline("rare"))
        .join(costs.select("word", "kind", "opens", "c", "p"), ["word", "kind", "opens"])
        .groupBy("row")
        .agg(F.sum(F.when((F.col("c") > 0) & token, F.col("n")).otherwise(0)).alias("k"), F.sum(F.when(token, F.col("n") * base).otherwise(0.0)).alias("b"), F.sum(F.col("n") * F.col("p")).alias("s"))
    )
    total = lambda x, y: F.col(x) + F.coalesce(F.col(y), F.lit(0))
    return (
        rows.drop("rare")
        .join(more, "row", "left")
        .select(
            id_col,
            "held_out",
            "n_tokens",
            total("n_known", "k").alias("n_known"),
            F.lit(n_train).cast("long").alias("train_tokens"),
            total("base_score", "b").alias("base_score"),
            total("score", "s").alias("score"),
            (-total("score", "s") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
        )
    )


RARE = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64()), ("opens", pa.bool_())]))
