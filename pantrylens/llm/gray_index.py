"""SimHash near-duplicates by a hierarchical index in Gray order.

Equal fingerprints are one node. Nodes are sorted by their rank in the Gray code, in which neighbours differ in few
bits, and cut into groups. What all fingerprints of a group share is a masked pattern; groups of eight share a coarser
one, and so on up. A search goes down from the top, adds up the bits in which the query differs from what each node
newly fixes, and drops a node with all that is below it once the sum is above the limit.

The index of the groups, of bounded size, says which groups a fingerprint has to visit; a pair of two groups meets
in the first of them only. Each group is then indexed down to its fingerprints, where the sum of differences is the
distance itself, and searched by its own and by the visiting ones. A group gives one link for each fingerprint it
joins to another, not its pairs; the links' components are the result. Groups with many visitors are dealt in slices.

Defined cases: a null text and one without words have fingerprint zero, linked like any other. With fewer words than a
shingle the whole sequence is the only shingle. Repeated rows are alike. A row without an id can link others; a
component's id is its smallest id present, null if it has none. An empty table gives an empty result. Columns
besides the id and the text are left aside, whatever their names. A text of any length is worked on in blocks of
shingles. Ties cannot matter: all links within the limit count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pantrylens.llm.components import connected
from pantrylens.llm.shared import Words, mixed, saved, steps, text_bytes

SEED = 42
#: Shingles whose bits are counted at once.
BLOCK = 50_000
#: Children of an index node.
FANOUT = 8
#: Queries that go down an index together.
QUERIES_AT_ONCE = 1024
#: Fingerprints of a group, and the least and the greatest number of groups; the greatest bounds what is broadcast.
GROUP_SIZE, LEAST_GROUPS, MOST_GROUPS = 20_000, 64, 65_536
#: Visitors of a group that one task takes.
SLICE = 200_000


def shingle_hashes(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every shingle (words joined by one space, repeats included), and its row."""
    keep = w.inside.copy()
    keep[w.end[:-1][w.row[1:] == w.row[:-1]]] = True
    at = np.zeros(len(keep) + 1, dtype=np.int64)
    np.cumsum(keep, out=at[1:])
    data = np.where(w.inside, w.buf, 32).astype(np.uint8)[keep].tobytes()
    head, tail = at[w.start], at[w.end]
    few = np.flatnonzero((w.per_row > 0) & (w.per_row < size))
    n = len(head) - size + 1
    first = np.flatnonzero(w.row[:n] == w.row[size - 1 :]) if n > 0 else np.zeros(0, dtype=np.int64)
    last = np.r_[first + size - 1, w.first_word[few] + w.per_row[few] - 1]
    first = np.r_[first, w.first_word[few]]
    order = np.argsort(first, kind="stable")
    first, last = first[order], last[order]
    digest = xxhash.xxh64_intdigest
    spans = zip(head[first].tolist(), tail[last].tolist())
    return np.fromiter((digest(data[a:b], SEED) for a, b in spans), dtype=np.uint64, count=len(first)), w.row[first]


def majority(hashes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """For each row the bits that over half of its hashes have; 0 for a row without."""
    votes = np.zeros((rows, 64), dtype=np.int64)
    for lo in range(0, len(hashes), BLOCK):
        part = row[lo : lo + BLOCK]
        bits = np.unpackbits(hashes[lo : lo + BLOCK].view(np.uint8).reshape(-1, 8), axis=1)
        heads = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        votes[part[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
    total = np.bincount(row, minlength=rows)
    return np.packbits(2 * votes > total[:, None], axis=1).view(np.uint64).ravel()


def gray_rank(fingerprints: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    rank = fingerprints.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def in_order(rank: np.ndarray) -> np.ndarray:
    """Unsigned values as signed ones of the same order."""
    return (rank ^ np.uint64(1 << 63)).view(np.int64)


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp, rank (in Gray order, signed) and node (a one-to-one hash of fp) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, starts, ends = text_bytes(batch.column(1))
            for lo, hi in steps(starts, ends):
                w = Words(buf, starts[lo:hi], ends[lo:hi], lower=True)
                fp = majority(*shingle_hashes(w, shingle), hi - lo)
                columns = [batch.column(0)[lo:hi], pa.array(fp.view(np.int64)), pa.array(in_order(gray_rank(fp))), pa.array(mixed(fp).view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "fp", "rank", "node"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, fp long, rank long, node long")


class GrayIndex:
    """Masked patterns over leaves in Gray order, each given by the bits that all, and that any, of its codes have."""

    def __init__(self, every: np.ndarray, some: np.ndarray):
        self.levels = []
        while True:
            mask = ~(every ^ some)
            self.levels.append((mask, every & mask))
            if len(every) <= FANOUT:
                break
            heads = np.arange(0, len(every), FANOUT)
            every, some = np.bitwise_and.reduceat(every, heads), np.bitwise_or.reduceat(some, heads)
        self.levels.reverse()

    def search(self, queries: np.ndarray, limit: int, last: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (query, leaf) within ``limit`` differences; with ``last``, no leaf beyond it."""
        children = np.arange(FANOUT)
        for lo in range(0, len(queries), QUERIES_AT_ONCE):
            code = queries[lo : lo + QUERIES_AT_ONCE]
            query = np.arange(len(code))
            node = np.zeros(len(code), dtype=np.int64)
            above = np.zeros(1, dtype=np.uint64)
            differ = np.zeros(len(code), dtype=np.int64)
            for k, (mask, pattern) in enumerate(self.levels):
                child = (node[:, None] * FANOUT + children).ravel()
                parent = np.repeat(np.arange(len(node)), FANOUT)
                ok = child < len(mask)
                if last is not None:
                    ok &= child <= last[lo + query[parent]] // FANOUT ** (len(self.levels) - 1 - k)
                child, parent = child[ok], parent[ok]
                fresh = mask[child] & ~above[node[parent]]
                query, differ = query[parent], differ[parent] + np.bitwise_count((code[query[parent]] ^ pattern[child]) & fresh)
                ok = differ <= limit
                query, node, differ, above = query[ok], child[ok], differ[ok], mask
            yield query + lo, node


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (the least member known of each element's set) with the sets of every a and b made one."""
    while True:
        left, right = root[a], root[b]
        apart = left != right
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(left[apart], right[apart]), np.minimum(left[apart], right[apart]))
        while True:
            higher = root[root]
            if (higher == root).all():
                break
            root = higher


def group_links(own: np.ndarray, visitors: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """A link from each code to the first of its set, of all codes within ``limit`` of one of ``own``."""
    own = own[np.argsort(gray_rank(own))]
    codes = np.r_[own, visitors]
    root = np.arange(len(codes))
    if len(own):
        for query, leaf in GrayIndex(own, own).search(codes, limit):
            root = joined(root, query, leaf)
    moved = np.flatnonzero(root != np.arange(len(codes)))
    return codes[moved], codes[root[moved]]


def links(nodes: DataFrame, limit: int, group_size: int = GROUP_SIZE, least_groups: int = LEAST_GROUPS, slice_size: int = SLICE) -> DataFrame:
    """Links a, b between ``nodes`` (distinct fp and rank, written) whose components are those of all pairs within ``limit``."""
    count = min(MOST_GROUPS, max(least_groups, -(-nodes.count() // group_size)))
    shares = [i / count for i in range(1, count)]
    cuts = nodes.select(F.percentile_approx("rank", shares, max(10_000, 20 * count))).first()[0] if shares else None
    bounds = np.unique(np.array(cuts or [], dtype=np.int64))

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = np.searchsorted(bounds, np.asarray(batch.column(1)), side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(group), batch.column(0)], names=["grp", "fp"])

    held = nodes.select("fp", "rank").mapInArrow(grouped, "grp int, fp long")
    # one row for each group: at most MOST_GROUPS
    summary = held.groupBy("grp").agg(F.bit_and("fp").alias("every"), F.bit_or("fp").alias("some")).orderBy("grp").collect()
    names = np.array([r["grp"] for r in summary], dtype=np.int32)
    index = GrayIndex(*(np.array([r[c] for r in summary], dtype=np.int64).view(np.uint64) for c in ("every", "some")))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = np.searchsorted(names, np.asarray(batch.column(0)))
            code = np.asarray(batch.column(1))
            for query, leaf in index.search(code.view(np.uint64), limit, home):
                columns = [pa.array(names[leaf]), pa.array(code[query]), pa.array(leaf == home[query])]
                yield pa.RecordBatch.from_arrays(columns, names=["grp", "fp", "own"])

    def solve(table: pa.Table) -> pa.Table:
        code, own = np.asarray(table["fp"]).view(np.uint64), np.asarray(table["own"])
        a, b = group_links(code[own], code[~own], limit)
        return pa.table({"a": pa.array(mixed(a).view(np.int64)), "b": pa.array(mixed(b).view(np.int64))})

    routed = saved(held.mapInArrow(visits, "grp int, fp long, own boolean"), "visits")
    # at most MOST_GROUPS rows of two numbers
    slices = F.broadcast(routed.groupBy("grp").agg((1 + F.floor(F.sum((~F.col("own")).cast("long")) / slice_size)).cast("int").alias("slices")))
    mine = F.when(F.col("own"), F.sequence(F.lit(0), F.col("slices") - 1)).otherwise(F.array(F.pmod(F.xxhash64("fp"), "slices").cast("int")))
    dealt = routed.join(slices, "grp").select("grp", "fp", "own", F.explode(mine).alias("slice")).repartition(count, "grp", "slice")
    return dealt.groupBy("grp", "slice").applyInArrow(solve, "a long, b long")


def near_fingerprints(docs: DataFrame, shingle: int = 3, limit: int = 2, id_col: str = "doc_id", text_col: str = "text", **grouping: int) -> DataFrame:
    """id, fp and component_id of every row."""
    rows = saved(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    nodes = saved(rows.groupBy("fp", "rank", "node").agg(F.min(id_col).alias("least")), "fingerprint-nodes")
    labels = connected(saved(links(nodes, limit, **grouping), "fingerprint-links"))
    labelled = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    component = labelled.select("fp", "label").join(least, "label").select("fp", "component_id")
    return rows.select(id_col, "fp").join(component, "fp").select(id_col, "fp", "component_id")
