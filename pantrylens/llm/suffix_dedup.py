"""Removal of byte strings that an earlier document has too, by a Burrows-Wheeler interval search.

Every window of ``least`` bytes has one anchor, the least hash among its grams; equal windows have
equal anchors. Consecutive windows with one anchor are a segment. Steps:

1. anchors of all texts are dealt by hash; those that one text alone has are dropped. A step of the
   scan that has seen an anchor in two texts sends it once, so that a passage in a great share of all
   texts does not gather in one task;
2. segments of shared anchors are cut from the texts; equal ones of a batch are merged;
3. the segments of one anchor meet in one task, where the interval search finds the windows that are
   equal and the smallest id of each. Of an anchor that very many texts have, the windows are merged
   by their content instead, which needs no common task;
4. each text removes the bytes of its windows that a smaller id has.

Texts that equal one with a smaller id take no part: all their windows are that text's.

Defined cases: a null text is empty and loses nothing, nor does one shorter than ``least``. Rows with
an equal id do not remove from each other. A null id counts as larger than all ids. Kept bytes are
returned as binary, as a cut can fall inside a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pantrylens.llm.bwt_intervals import shared_prefix_groups
from pantrylens.llm.shared import SMALL_STEP_BYTES, giving_back, prefix_sums, saved, span_hash, steps, text_bytes

GRAM = 20
NO_ID = (1 << 63) - 1
#: Bytes of anchors in a task that looks for shared ones, and of segments in one transform.
SHARD_BYTES, TRANSFORM_BYTES = 16 << 20, 1 << 19
#: Texts with one anchor beyond which it is hot, and the most anchors that can be hot (8 MB of hashes).
HOT_TEXTS, MOST_HOT = 100_000, 1_000_000
#: Rows of one batch whose texts share one list of keys.
BATCH_ROWS = 60_000

# An anchor on its way: 48 bits of its hash, its text's place in the list of keys, first window, number of windows.
ENTRY = np.dtype([("low", "<u4"), ("high", "<u2"), ("row", "<u2"), ("at", "<u4"), ("n", "u1")])
RUN = np.dtype([("hash", "<u8"), ("at", "<u4"), ("n", "u1")])
WHO = np.dtype([("key", "<i8"), ("doc", "<i8"), ("at", "<u4")])


def segments(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int):
    """Runs of windows with one anchor: anchor hash, row, first window (in its row), number of windows."""
    base = int(starts[0])
    buf = buf[base : int(ends[-1])]
    size = ends - starts
    none = np.zeros(0, np.int64)
    if len(buf) < least:
        return none.astype(np.uint64), none, none, none
    at = np.arange(len(buf) - GRAM + 1)
    hashes = span_hash(prefix_sums(buf), at, at + GRAM)
    # smallest hash of least - GRAM + 1 neighbours, the leftmost of equal ones; the place rides in the low half
    best = (hashes & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    width, want = 1, least - GRAM + 1
    while 2 * width <= want:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if width < want:
        best = np.minimum(best[: len(best) - (want - width)], best[want - width :])
    anchor = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(starts)), size)[: len(anchor)]
    left = np.repeat(ends - base, size)[: len(anchor)] - np.arange(len(anchor))
    window = np.flatnonzero(left >= least)
    if not len(window):
        return none.astype(np.uint64), none, none, none
    anchor, row = anchor[window], row[window]
    head = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])
    n = np.diff(np.r_[head, len(window)])
    return hashes[anchor[head]], row[head], window[head] - (starts[row[head]] - base), n


def runs_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Heads of runs of equal values, and the run of each element."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.r_[True, x[1:] != x[:-1]]
    return np.flatnonzero(new), np.cumsum(new) - 1


def many_keys(keys: np.ndarray, head: np.ndarray) -> np.ndarray:
    """For each run, whether it holds two different keys."""
    if not len(keys):
        return np.zeros(0, bool)
    return np.minimum.reduceat(keys, head) != np.maximum.reduceat(keys, head)


def anchors(texts: DataFrame, least: int, shards: int) -> DataFrame:
    """shard, known, keys, data: a batch's entries, dealt by hash, or by text where known to be shared."""

    def packed(shard: np.ndarray, known: bool, entries: np.ndarray, keys: np.ndarray):
        order = np.argsort(shard, kind="stable")
        shard, entries = shard[order], entries[order]
        head, _ = runs_of(shard)
        for a, b in zip(head.tolist(), [*head[1:].tolist(), len(shard)]):
            part = entries[a:b].copy()
            used, part["row"] = np.unique(part["row"], return_inverse=True)
            yield int(shard[a]), known, keys[used].tobytes(), part.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(first, BATCH_ROWS)
                buf, starts, ends = text_bytes(batch.column(1))
                keys = np.asarray(batch.column(0)).astype(np.int64)
                found = []
                for lo, hi in steps(starts, ends, SMALL_STEP_BYTES):
                    h, row, at, n = segments(buf, starts[lo:hi], ends[lo:hi], least)
                    part = np.empty(len(h), dtype=ENTRY)
                    part["low"], part["high"] = (h >> np.uint64(16)) & np.uint64(0xFFFFFFFF), h >> np.uint64(48)
                    part["row"], part["at"], part["n"] = lo + row, at, n
                    found.append(part)
                entries = np.concatenate(found) if found else np.zeros(0, ENTRY)
                name = hash_of(entries)
                order = np.argsort(name, kind="stable")
                entries, name = entries[order], name[order]
                head, group = runs_of(name)
                several = many_keys(keys[entries["row"]], head)[group]
                # one entry tells the others of an anchor that several texts of this batch have, and how many
                told = np.flatnonzero(several & np.r_[True, group[1:] != group[:-1]]) if len(entries) else np.zeros(0, np.int64)
                tell = entries[told].copy()
                tell["n"], tell["at"] = 0, np.bincount(group, minlength=1)[group[told]] if len(told) else 0
                by_hash = np.concatenate([entries[~several], tell])
                rows = list(packed((np.r_[name[~several], name[told]] % np.uint64(shards)).astype(np.int64), False, by_hash, keys))
                by_text = entries[several]
                rows += packed(keys[by_text["row"]] % shards, True, by_text, keys)
                for k in range(0, len(rows), 500):
                    part = rows[k : k + 500]
                    yield pa.RecordBatch.from_pydict({f.name: [r[i] for r in part] for i, f in enumerate(SENT)}, schema=SENT)

    return texts.select("key", "text").mapInArrow(giving_back(run), "shard long, known boolean, keys binary, data binary")


SENT = pa.schema([("shard", pa.int64()), ("known", pa.bool_()), ("keys", pa.binary()), ("data", pa.binary())])


def hash_of(entries: np.ndarray) -> np.ndarray:
    return entries["low"].astype(np.uint64) | (entries["high"].astype(np.uint64) << np.uint64(32))


def shared_runs(sent: DataFrame, hot_from: int) -> DataFrame:
    """key and runs of the texts that have an anchor which another text has too, several rows a text.

    A row without a key lists hot anchors.
    """

    def by_key(name: np.ndarray, key: np.ndarray, entries: np.ndarray):
        order = np.argsort(key, kind="stable")
        slim = np.empty(len(order), dtype=RUN)
        slim["hash"], slim["at"], slim["n"] = name[order], entries["at"][order], entries["n"][order]
        key = key[order]
        head, _ = runs_of(key)
        for a, b in zip(head.tolist(), [*head[1:].tolist(), len(key)]):
            yield int(key[a]), slim[a:b].tobytes()

    def meet(table: pa.Table) -> pa.Table:
        entries, keys, known = [], [], []
        for is_known, names, data in zip(*(table[c].to_pylist() for c in ("known", "keys", "data"))):
            part = np.frombuffer(data, dtype=ENTRY)
            entries.append(part)
            keys.append(np.frombuffer(names, dtype=np.int64)[part["row"]])
            known.append(np.full(len(part), is_known))
        entries, key, known = np.concatenate(entries), np.concatenate(keys), np.concatenate(known)
        name = hash_of(entries)
        rows = list(by_key(name[known], key[known], entries[known]))
        entries, key, name = entries[~known], key[~known], name[~known]
        order = np.argsort(name, kind="stable")
        entries, key, name = entries[order], key[order], name[order]
        head, group = runs_of(name)
        if len(entries):
            told = entries["n"] == 0
            several = (many_keys(key, head) | np.logical_or.reduceat(told, head))[group] & ~told
            rows += by_key(name[several], key[several], entries[several])
            texts = np.add.reduceat(np.where(told, entries["at"], 1).astype(np.int64), head)
            hot = name[head][texts > hot_from]
            if len(hot):
                rows.append((None, hot.tobytes()))
        return pa.table({"key": pa.array([r[0] for r in rows], pa.int64()), "data": pa.array([r[1] for r in rows], pa.binary())})

    return sent.groupBy("shard").applyInArrow(meet, "key long, data binary")


def cut_segments(texts: DataFrame, least: int, hot: np.ndarray, want_hot: bool) -> DataFrame:
    """hash, segment, who: each shared run's text, merged within a batch, and the texts and places that have it.

    ``texts``: key, doc, text, runs. ``hot``: sorted hashes; the others are cut, or with ``want_hot`` only they.
    """
    shared = texts.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, starts, _ = text_bytes(batch.column(2))
            data = buf.tobytes() if len(buf) else b""
            keys, docs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}
            held = 0
            for i, runs in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                runs = np.unique(np.frombuffer(b"".join(runs), dtype=RUN))
                runs = runs[np.isin(runs["hash"], shared.value) == want_hot] if len(shared.value) else runs[: 0 if want_hot else None]
                lo = starts[i] + runs["at"].astype(np.int64)
                hi = lo + runs["n"] + least - 1
                for name, a, b, at in zip(runs["hash"].view(np.int64).tolist(), lo.tolist(), hi.tolist(), runs["at"].tolist()):
                    found.setdefault((name, data[a:b]), []).append((keys[i], docs[i], at))
                held += len(runs)
                if held > 100_000:
                    yield from emit(found)
                    found, held = {}, 0
            yield from emit(found)

    def emit(found: dict) -> Iterator[pa.RecordBatch]:
        rows = list(found.items())
        for k in range(0, len(rows), 5000):
            part = rows[k : k + 5000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0][0] for r in part], pa.int64()),
                    pa.array([r[0][1] for r in part], pa.binary()),
                    pa.array([np.array(r[1], dtype=WHO).tobytes() for r in part], pa.binary()),
                ],
                names=["hash", "segment", "who"],
            )

    return texts.mapInArrow(giving_back(run), "hash long, segment binary, who binary")


def lost_windows(who: list[bytes], ids: list[np.ndarray]) -> pa.RecordBatch:
    """key, first, end of the windows for which a smaller id is known. ``ids``: of each segment's windows."""
    each = np.array([len(w) // WHO.itemsize for w in who], dtype=np.int64)
    have = np.frombuffer(b"".join(who), dtype=WHO)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    size = np.array([len(x) for x in ids], dtype=np.int64)
    segment = np.repeat(np.arange(len(each)), each)
    n = size[segment]
    owner = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    smallest = flat[(np.cumsum(size) - size)[segment][owner] + nth]
    hit = np.flatnonzero(smallest < have["doc"][owner])
    row = owner[hit]
    place = have["at"][row].astype(np.int64) + nth[hit]
    new = np.r_[True, (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)] if len(hit) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    last = np.r_[head[1:], len(hit)] - 1 if len(head) else head
    return pa.RecordBatch.from_arrays(
        [pa.array(have["key"][row[head]]), pa.array(place[head]), pa.array(place[last] + 1)], names=["key", "first", "end"]
    )


LOST = "key long, first long, end long"


def searched(pieces: DataFrame, least: int) -> DataFrame:
    """LOST rows, from an interval search over the segments of some anchors at a time.

    ``pieces``: as ``cut_segments`` has them, with all rows of a hash in one partition, sorted by hash.
    """

    def search(parts: list[bytes], who: list[bytes]) -> pa.RecordBatch:
        index: dict[bytes, int] = {}
        of = np.array([index.setdefault(p, len(index)) for p in parts], dtype=np.int64)
        docs = np.full(len(index), NO_ID)
        np.minimum.at(docs, of, [np.frombuffer(w, dtype=WHO)["doc"].min() for w in who])
        size = np.array([len(p) for p in index], dtype=np.int64)
        flat = np.frombuffer(b"\0".join(index) + b"\0", dtype=np.uint8).astype(np.int32) + 1
        ends = np.cumsum(size + 1) - 1
        flat[ends] = 0
        order, group = shared_prefix_groups(flat, least)
        owner = np.repeat(np.arange(len(size)), size + 1)
        usable = ends[owner] - np.arange(len(flat)) >= least
        mine = usable[order]
        order, group = order[mine], group[mine]
        head, run = runs_of(group)
        ids = np.empty(len(flat), dtype=np.int64)
        ids[order] = np.minimum.reduceat(docs[owner[order]], head)[run]
        begin, windows = ends - size, size - least + 1
        return lost_windows(who, [ids[begin[k] : begin[k] + windows[k]] for k in of.tolist()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        who: list[bytes] = []
        held, last = 0, None
        for batch in batches:
            for name, part, has in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if held >= TRANSFORM_BYTES and name != last:
                    yield search(parts, who)
                    parts, who, held = [], [], 0
                parts.append(part)
                who.append(has)
                held += len(part) + 1
                last = name
        if parts:
            yield search(parts, who)

    return pieces.mapInArrow(giving_back(run), LOST)


def merged_by_content(pieces: DataFrame, least: int) -> DataFrame:
    """LOST rows of hot anchors: the windows of different segments are merged by content, with no common task."""

    @F.pandas_udf("long")
    def smallest(x):
        import pandas as pd

        return pd.Series([int(np.frombuffer(w, dtype=WHO)["doc"].min()) for w in x])

    distinct = pieces.select("hash", "segment", smallest("who").alias("doc")).groupBy("hash", "segment").agg(F.min("doc").alias("doc"))
    n = (F.octet_length("segment") - least + 1).cast("int")
    windows = distinct.select("hash", "segment", "doc", F.explode(F.sequence(F.lit(1), n)).alias("nth")).withColumn(
        "window", F.substring("segment", F.col("nth"), F.lit(least))
    )
    by_window = windows.groupBy("window").agg(F.min("doc").alias("id"))
    named = windows.drop("doc").join(by_window, "window").groupBy("hash", "segment").agg(F.array_sort(F.collect_list(F.struct("nth", "id"))).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield lost_windows(batch.column(0).to_pylist(), [np.array(x, dtype=np.int64) for x in batch.column(1).to_pylist()])

    return pieces.join(named, ["hash", "segment"]).select("who", F.col("x.id").alias("ids")).mapInArrow(run, LOST)


def remove_repeats(docs: DataFrame, least: int = 50, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, carried columns, n_bytes, n_removed, n_spans, spans (array of first byte, end) and kept (binary)."""
    if least < GRAM + 8:
        raise ValueError(f"windows of fewer than {GRAM + 8} bytes have too few grams to choose an anchor from")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    # Rows with an equal id and text share a key: they lose the same bytes.
    key = F.xxhash64(doc, text)
    names = [id_col, *carry]
    plain = [f"c{k}" for k in range(len(names))]
    keyed = docs.select(key.alias("key"), doc.alias("doc"), text.alias("text"), *[F.col(c).alias(p) for c, p in zip(names, plain)])
    brief = saved(keyed.select("key", "doc", F.md5(F.col("text").cast("binary")).alias("digest"), F.octet_length("text").alias("n")), "digests")
    total = brief.agg(F.sum("n")).first()[0] or 0
    first = brief.groupBy("digest").agg(F.min("doc").alias("first"))
    copies = saved(brief.join(first, "digest").where(F.col("doc") > F.col("first")).select("key").distinct(), "copies")
    n_anchors = total // 16  # about one for every 16 bytes of text
    shards = max(8, n_anchors * ENTRY.itemsize // SHARD_BYTES)
    runs = saved(shared_runs(anchors(keyed, least, shards), max(HOT_TEXTS, n_anchors // MOST_HOT)), "shared-runs")
    hot = np.sort(np.frombuffer(b"".join(r["data"] for r in runs.where("key is null").collect()), dtype=np.uint64))
    of_text = runs.where("key is not null").groupBy("key").agg(F.collect_list("data").alias("runs")).join(copies, "key", "left_anti")
    # The same columns as in the last join, so that the texts are shuffled once for both.
    texts = keyed.join(of_text, "key").select("key", "doc", "text", *plain, "runs")
    lost = searched(cut_segments(texts, least, hot, False).repartition("hash").sortWithinPartitions("hash"), least)
    if len(hot):
        lost = lost.union(merged_by_content(saved(cut_segments(texts, least, hot, True), "hot-segments"), least))
    marks = lost.groupBy("key").agg(F.collect_list(F.struct("first", "end")).alias("windows")).join(copies.withColumn("whole", F.lit(True)), "key", "full")
    kinds = dict(docs.dtypes)
    outputs = "n_bytes long, n_removed long, n_spans long, spans array<array<long>>, kept binary"
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", " + outputs

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                rows = zip(*(part.column(c).to_pylist() for c in ("text", "whole", "windows")))
                got = [without(t.encode(), whole, windows, least) for t, whole, windows in rows]
                yield pa.RecordBatch.from_arrays(
                    [part.column(p) for p in plain]
                    + [pa.array([g[k] for g in got], pa.int64()) for k in range(3)]
                    + [pa.array([g[3] for g in got], pa.list_(pa.list_(pa.int64()))), pa.array([g[4] for g in got], pa.binary())],
                    names=[*names, *(o.split()[0] for o in outputs.split(", "))],
                )

    return keyed.join(marks, "key", "left").select("key", "doc", "text", *plain, "whole", "windows").mapInArrow(giving_back(cut), schema)


def without(data: bytes, whole: bool | None, windows: list | None, least: int) -> tuple[int, int, int, list, bytes]:
    """(bytes, removed, spans, their places, what is left) of one text."""
    n = len(data)
    if whole:
        return (n, n, 1, [[0, n]], b"") if n >= least else (n, 0, 0, [], data)
    spans: list[list[int]] = []
    for a, b in sorted((w["first"], w["end"] + least - 1) for w in windows or []):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    out, at = [], 0
    for a, b in spans:
        out.append(data[at:a])
        at = b
    out.append(data[at:])
    kept = b"".join(out)
    return n, n - len(kept), len(spans), spans, kept

