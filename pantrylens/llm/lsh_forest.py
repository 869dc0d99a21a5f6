"""MinHash near-duplicates by an LSH forest.

Texts with equal shingle sets are one node; only nodes are compared. Every node has a MinHash
signature, cut into trees of several hash values each. A tree is the nodes sorted by its values, so
that nodes with a long common prefix lie side by side. Around each node the depth adapts: the
shallowest prefix, from ``least_depth`` on, that no more than ``region`` neighbours share. Pairs in
such a region whose two-bit sketches look alike are candidates.

The first rounds confirm on the full sets, for each node, its most alike candidate of another
component and its hub: of the candidates that are surely near, the first in an order all agree on, so
that a large group gathers around few nodes. What is linked is joined.

The last round leaves no region out. All nodes that share ``least_depth`` values of a tree are a
bucket; buckets of one component are done. Of the others, two members of different components are
compared in the first tree whose bucket they share, whatever the size of the bucket: one of more than
``wide_region`` members, or of very long texts, is dealt into blocks, and every two blocks meet in a
group of their own. First only signatures travel, and mark the nodes with a pair worth confirming;
then the full sets of those nodes. A group gives the links that join its components, never its pairs.

A pair of similarity s shares a prefix of d values in one of T trees with probability
1 - (1 - s^d)^T; at 0.8, depth 3 and 16 trees this is 0.99999. Its signatures agree in too few values
with probability 0.00003 at most. A range boundary between two neighbours costs the first rounds one
tree of a pair, and the last round nothing. The last round's work is quadratic in the members of one
bucket that are not yet of one component.

Defined cases: a null text, or one without words, has an empty set and is its own component. With
fewer words than a shingle the whole sequence is the only shingle. Rows are told apart by their
texts: rows with an equal id and text are alike in all outputs. A row without an id can link others
but a component's id is its smallest id present; it is kept only if no row of its component has one. A very
long text is a step, and at most a block, of its own. Columns other than id and text are not read, so
their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pantrylens.llm.components import connected
from pantrylens.llm.shared import SMALL_STEP_BYTES, Words, mixed, saved, steps, text_bytes, word_windows

TREES, DEPTH = 16, 8
HASHES = TREES * DEPTH
#: Shingles that a block holds for each member it may have.
SHINGLES_A_MEMBER = 512
_ODD = np.uint64(0x2545F4914F6CDD1D)


def shingles(buf, starts, ends, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted by row, and the number per row."""
    w = Words(buf, starts, ends, lower=True)
    hashes = w.hashes()
    runs, at = word_windows(w, hashes, size)
    row = w.row[at]
    few = np.flatnonzero((w.per_row > 0) & (w.per_row < size))
    if len(few):
        whole = np.zeros(len(few), dtype=np.uint64)
        for k in range(size - 1):
            more = w.per_row[few] > k
            whole[more] = mixed(whole[more] * np.uint64(0x100000001B3) + hashes[w.first_word[few[more]] + k])
        runs = np.r_[runs, mixed(whole + w.per_row[few].astype(np.uint64))]
        row = np.r_[row, few]
    # one sort by a key that keeps rows apart, instead of one per row
    order = np.lexsort((runs, row))
    runs, row = runs[order], row[order]
    new = np.ones(len(runs), dtype=bool)
    new[1:] = (runs[1:] != runs[:-1]) | (row[1:] != row[:-1])
    return runs[new], np.bincount(row[new], minlength=w.rows)


def signatures(sets: np.ndarray, per_row: np.ndarray) -> np.ndarray:
    """MinHash values (32 bits) of each row that has shingles; rows without are left out."""
    per_row = per_row[per_row > 0]
    heads = np.cumsum(per_row) - per_row
    out = np.empty((len(per_row), HASHES), dtype=np.uint32)
    low, high = sets.astype(np.uint32), (sets >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    value = low.copy()
    for k in range(HASHES):
        value += high
        v = value ^ (value >> np.uint32(15))
        v *= np.uint32(0x2C1B3C6D)
        v ^= v >> np.uint32(12)
        v *= np.uint32(0x297A2D39)
        out[:, k] = np.minimum.reduceat(v, heads)
    return out


def node_keys(sets: np.ndarray, per_row: np.ndarray) -> np.ndarray:
    """16 bytes for each row that has shingles, equal for equal sets."""
    n = per_row[per_row > 0]
    heads = np.cumsum(n) - n
    both = np.empty((len(n), 2), dtype=np.uint64)
    both[:, 0] = np.add.reduceat(mixed(sets + _ODD), heads)
    both[:, 1] = mixed(np.add.reduceat(mixed(sets ^ (_ODD << np.uint64(1))), heads) + n.astype(np.uint64))
    return both


def signed(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """id, tag (a hash of the text), n_shingles, node (null for an empty set) and sig of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, starts, ends = text_bytes(batch.column(1))
            for lo, hi in steps(starts, ends, SMALL_STEP_BYTES):
                sets, per_row = shingles(buf, starts[lo:hi], ends[lo:hi], size)
                some = np.flatnonzero(per_row)
                nodes, sigs = [None] * (hi - lo), [None] * (hi - lo)
                if len(some):
                    short = signatures(sets, per_row).astype(">u2")
                    for i, key, sig in zip(some.tolist(), node_keys(sets, per_row), short):
                        nodes[i], sigs[i] = key.tobytes(), sig.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], batch.column(2)[lo:hi], pa.array(per_row, pa.int64()), pa.array(nodes, pa.binary())]
                    + [pa.array(sigs, pa.binary())],
                    names=[id_col, "tag", "n_shingles", "node", "sig"],
                )

    kind = dict(docs.dtypes)[id_col]
    text = F.col(text_col).cast("string")
    return docs.select(id_col, text.alias("text"), F.xxhash64(text).alias("tag")).mapInArrow(
        run, f"`{id_col}` {kind}, tag long, n_shingles long, node binary, sig binary"
    )


def branches(nodes: DataFrame) -> DataFrame:
    """Each node in each tree: tree, key (its hash values), node, n, sketch, label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                sig = np.frombuffer(b"".join(part.column(2).to_pylist()), dtype=">u2").reshape(-1, HASHES)
                two = (sig & 3).astype(np.uint8).reshape(len(sig), -1, 4)
                sketch = (two[:, :, 0] | two[:, :, 1] << 2 | two[:, :, 2] << 4 | two[:, :, 3] << 6).astype(np.uint8)
                sketches = pa.array([s.tobytes() for s in sketch], pa.binary())
                for t in range(TREES):
                    keys = pa.array([k.tobytes() for k in np.ascontiguousarray(sig[:, t * DEPTH : (t + 1) * DEPTH])], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(sig), t, np.int32)), keys, part.column(0), part.column(1), sketches, part.column(3)],
                        names=["tree", "key", "node", "n", "sketch", "label"],
                    )

    rows = nodes.select("node", "n", "sig", "label").mapInArrow(run, "tree int, key binary, node binary, n long, sketch binary, label binary")
    return rows.withColumn("salt", F.xxhash64("node")).repartitionByRange("tree", "key", "salt").sortWithinPartitions("tree", "key", "salt")


def alike(rows: DataFrame, percent: int, region: int, least_depth: int) -> DataFrame:
    """Candidate pairs (node, to) of neighbouring rows in different components, with their sketch similarity.

    Each row in its tree gives the most alike row, and as ``hub`` the rank of the first row, in one
    order that all rows agree on, among those that are surely near.
    """
    j = percent / 100
    # three and a half standard deviations below the share of equal two-bit values expected at the threshold
    expected = j + (1 - j) / 4
    least_same = HASHES * (expected - 3.5 * (expected * (1 - expected) / HASHES) ** 0.5)
    sure_same = HASHES * (expected + 0.25 * (1 - expected))
    odd_bits = np.uint64(0x5555555555555555)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            n_old = 0
            if carried is not None:
                n_old = carried.num_rows
                table = pa.concat_tables([carried, table])
            carried = table.slice(max(0, table.num_rows - region))
            whole = table.combine_chunks()
            yield pairs(whole, n_old)

    def pairs(table: pa.Table, old: int) -> pa.RecordBatch:
        n = table.num_rows
        tree = np.asarray(table["tree"])
        key = np.frombuffer(b"".join(table["key"].to_pylist()), dtype=np.uint8).view(">u2").reshape(n, DEPTH)
        sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), dtype=np.uint64).reshape(n, -1)
        size, salt = np.asarray(table["n"]), np.asarray(table["salt"])
        nodes, labels = table["node"].to_pylist(), table["label"].to_pylist()
        label = np.unique(np.array([hash(x) for x in labels]), return_inverse=True)[1] if n else np.zeros(0, int)
        same = key[1:] == key[:-1]
        common = np.where(tree[1:] == tree[:-1], np.cumprod(same, axis=1).sum(axis=1), 0)
        depth = np.full(n, DEPTH)
        for d in range(DEPTH, least_depth - 1, -1):
            run = np.r_[0, np.cumsum(common < d)]
            depth[np.bincount(run)[run] <= region] = d
        left, right, likes = [], [], []
        reach = common.copy()
        for s in range(1, min(region, n - 1) + 1 if n > 1 else 1):
            if s > 1:
                reach = np.minimum(reach[:-1], common[s - 1 :])
            if not (reach >= least_depth).any():
                break
            i = np.flatnonzero(reach >= np.minimum(depth[: n - s], depth[s:]))
            i = i[(i + s >= old) & (label[i] != label[i + s])]
            lo, hi = np.minimum(size[i], size[i + s]), np.maximum(size[i], size[i + s])
            i = i[100 * lo >= percent * hi]
            x = sketch[i] ^ sketch[i + s]
            equal = HASHES - np.bitwise_count((x | (x >> np.uint64(1))) & odd_bits).sum(axis=1)
            ok = equal >= least_same
            left.append(i[ok])
            right.append(i[ok] + s)
            likes.append(equal[ok])
        if not left:
            left, right, likes = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0, int)]
        a, b, like = np.concatenate(left), np.concatenate(right), np.concatenate(likes)
        ends, other, likes = np.r_[a, b], np.r_[b, a], np.r_[like, like]
        best = first_of(ends, np.lexsort((np.abs(ends - other), -likes, ends)))
        near = np.flatnonzero((likes >= sure_same) & (salt[other] < salt[ends]))
        hub = near[first_of(ends[near], np.lexsort((salt[other][near], ends[near])))]
        rows = np.r_[best, hub]
        is_hub = np.r_[np.zeros(len(best), bool), np.ones(len(hub), bool)]
        a, b, like = ends[rows], other[rows], likes[rows]
        order_of = pa.array(salt[b], pa.int64(), mask=~is_hub)
        return pa.RecordBatch.from_arrays(
            [pa.array([nodes[i] for i in a.tolist()], pa.binary()), pa.array([nodes[i] for i in b.tolist()], pa.binary()), pa.array(like, pa.int64()), order_of],
            names=["node", "to", "alike", "hub"],
        )

    return rows.mapInArrow(run, "node binary, to binary, alike long, hub long")


def first_of(groups: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The first element of each group, by ``order``, which sorts by group first."""
    if not len(order):
        return order
    ranked = groups[order]
    return order[np.r_[True, ranked[1:] != ranked[:-1]]]


def chosen(found: DataFrame) -> DataFrame:
    """Pairs a < b: each node with its most alike candidate, and with the hub among the very alike ones."""
    by_node = found.groupBy("node").agg(
        F.max(F.struct("alike", "to")).alias("best"), F.min(F.when(F.col("hub").isNotNull(), F.struct("hub", "to"))).alias("centre")
    )
    ends = by_node.select("node", F.explode(F.array("best.to", "centre.to")).alias("to")).where("to is not null")
    return ends.select(F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b")).distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity. ``texts``: node and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                sides = []
                for k in (2, 3):
                    sets, per_row = shingles(*text_bytes(part.column(k)), size)
                    row = np.repeat(np.arange(len(per_row)), per_row)
                    sides.append((mixed(sets + mixed(row.astype(np.uint64))), row, per_row))
                (left, row, n_left), (right, _, n_right) = sides
                both = np.bincount(row[np.isin(left, right)], minlength=part.num_rows)
                ok = 100 * both >= percent * (n_left + n_right - both)
                yield part.filter(pa.array(ok)).select(["a", "b"])

    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def blocks(nodes: DataFrame, wide_region: int, least_depth: int) -> DataFrame:
    """Each node in each bucket of several components: bucket, tree, p and q (two blocks, or one twice), part (the node's), node.

    Buckets are counted before anything is joined to them; only their hashes, components and set sizes travel.
    """
    width = 2 * DEPTH
    prefix = F.array(*[F.xxhash64(F.lit(t), F.substring("sig", 1 + t * width, 2 * least_depth)) for t in range(TREES)])
    keys = nodes.select("node", "n", F.xxhash64("label").alias("of"), F.posexplode(prefix).alias("tree", "bucket"))
    sizes = keys.groupBy("bucket").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"), F.min("of").alias("first"), F.max("of").alias("last"))
    parts = F.ceil(F.greatest("rows", F.col("shingles") / SHINGLES_A_MEMBER) / wide_region)
    several = sizes.where("first <> last").select("bucket", F.least("rows", parts).alias("parts"))
    dealt = keys.join(several, "bucket").withColumn("part", F.pmod(F.xxhash64("node", F.lit("part")), "parts"))
    meets = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return meets.select("bucket", "tree", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "node")


def by_group(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q")


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with each row's group number; the last group of a batch waits for the next batch."""

    def numbered(table: pa.Table) -> np.ndarray:
        keys = np.array([np.asarray(table[c]) for c in ("bucket", "p", "q")])
        return np.r_[0, np.cumsum((keys[:, 1:] != keys[:, :-1]).any(axis=0))]

    left = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if left is not None:
            table = pa.concat_tables([left, table])
        group = numbered(table)
        cut = int(np.searchsorted(group, group[-1]))
        if cut:
            yield table.slice(0, cut).combine_chunks(), group[:cut]
        left = table.slice(cut)
    if left is not None:
        yield left.combine_chunks(), numbered(left)


class Members:
    """Members of a few groups, and which of their pairs are worth confirming."""

    def __init__(self, table: pa.Table, percent: int, least_depth: int):
        self.percent, self.depth = percent, least_depth
        j = percent / 100
        # four standard deviations below the share of equal values expected at the threshold
        self.least_same = HASHES * (j - 4 * (j * (1 - j) / HASHES) ** 0.5)
        self.sig = np.frombuffer(b"".join(table["sig"].to_pylist()), dtype=np.uint16).reshape(-1, HASHES)
        self.size, self.tree, self.part = (np.asarray(table[c]) for c in ("n", "tree", "part"))
        self.one_block = np.asarray(table["p"]) == np.asarray(table["q"])
        number: dict[bytes, int] = {}
        self.component = np.array([number.setdefault(x, len(number)) for x in table["label"].to_pylist()], dtype=np.int64)

    def worth(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs are of two components, meet here and nowhere before, and may be near."""
        lo, hi = np.minimum(self.size[a], self.size[b]), np.maximum(self.size[a], self.size[b])
        ok = (self.component[a] != self.component[b]) & (self.one_block[a] | (self.part[a] != self.part[b])) & (100 * lo >= self.percent * hi)
        at = np.flatnonzero(ok)
        same = self.sig[a[at]] == self.sig[b[at]]
        shared = same.reshape(-1, TREES, DEPTH)[:, :, : self.depth].all(axis=2)
        ok[at] = (same.sum(axis=1) >= self.least_same) & (shared.argmax(axis=1) == self.tree[a[at]])
        return ok


def open_nodes(nodes: DataFrame, percent: int, wide_region: int, least_depth: int) -> DataFrame:
    """The rows of ``blocks`` whose node has a pair worth confirming in that group."""
    columns = ["bucket", "tree", "p", "q", "part", "node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches):
            members = Members(table, percent, least_depth)
            found = np.zeros(len(group), dtype=bool)
            a = np.arange(len(group))
            for s in range(1, len(group)):
                a = a[a + s < len(group)]
                a = a[group[a] == group[a + s]]
                if not len(a):
                    break
                ok = a[members.worth(a, a + s)]
                found[ok] = found[ok + s] = True
            yield from table.filter(pa.array(found)).select(columns).combine_chunks().to_batches()

    facts = nodes.select("node", "n", "sig", "label")
    rows = by_group(blocks(nodes, wide_region, least_depth).join(facts, "node"))
    return rows.select(*columns, "n", "sig", "label").mapInArrow(run, "bucket long, tree int, p long, q long, part long, node binary")


def node_sets(texts: DataFrame, size: int) -> DataFrame:
    """node and its sorted shingle hashes, 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, starts, ends = text_bytes(batch.column(1))
            for lo, hi in steps(starts, ends, SMALL_STEP_BYTES):
                sets, per_row = shingles(buf, starts[lo:hi], ends[lo:hi], size)
                packed = [x.tobytes() for x in np.split(sets, np.cumsum(per_row)[:-1])]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(packed, pa.binary())], names=["node", "hashes"])

    return texts.select("node", "text").mapInArrow(run, "node binary, hashes binary")


def block_links(opened: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, least_depth: int) -> DataFrame:
    """Links a, b, confirmed on the full sets, that join the components of each group of ``opened``."""

    def near(members: Members, sets: list[np.ndarray], a: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` that are near to ``a``; its sets are looked up in steps of bounded size."""
        out = [np.zeros(0, np.int64)]
        ends = np.cumsum(members.size[others])
        for lo, hi in steps(ends - members.size[others], ends, SMALL_STEP_BYTES):
            some = others[lo:hi]
            hashes = np.concatenate([sets[k] for k in some.tolist()])
            at = np.minimum(np.searchsorted(sets[a], hashes), len(sets[a]) - 1)
            both = np.add.reduceat((sets[a][at] == hashes).astype(np.int64), np.cumsum(members.size[some]) - members.size[some])
            out.append(some[100 * both >= percent * (members.size[a] + members.size[some] - both)])
        return np.concatenate(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches):
            members = Members(table, percent, least_depth)
            sets = [np.frombuffer(x, dtype=np.uint64) for x in table["hashes"].to_pylist()]
            names = table["node"].to_pylist()
            left, right = [], []
            edges = np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(group)]
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                component = members.component[lo:hi]
                for a in range(lo, hi - 1):
                    others = np.arange(a + 1, hi)
                    others = others[members.worth(np.full(len(others), a), others)]
                    for b in near(members, sets, a, others).tolist():
                        if members.component[a] != members.component[b]:
                            left.append(names[a])
                            right.append(names[b])
                            component[component == members.component[b]] = members.component[a]
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])

    facts = nodes.select("node", "n", "sig", "label").join(sets, "node")
    rows = by_group(opened.join(facts, "node"))
    return rows.select("bucket", "tree", "p", "q", "part", "node", "n", "sig", "label", "hashes").mapInArrow(run, "a binary, b binary")


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    percent: int = 80,
    region: int = 96,
    wide_region: int = 1024,
    rounds: int = 3,
    least_depth: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept (whether it stands for its component)."""
    rows = saved(signed(docs, shingle, id_col, text_col), "signatures")
    nodes = saved(
        rows.where("node is not null").groupBy("node").agg(F.min(id_col).alias("least"), F.first(named_row(id_col)).alias("of"), F.first("tag").alias("tag"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")),
        "nodes",
    )
    found = saved(alike(branches(nodes.withColumn("label", F.col("node"))), percent, region, least_depth), "candidates")
    named = saved(found.select("node").union(found.select("to")).distinct().join(nodes, "node"), "near-nodes")
    texts = saved(node_texts(docs, named, id_col, text_col), "near-texts")
    labels = named.select("node", F.col("node").alias("label"))
    seen = None
    for k in range(rounds):
        labelled = saved(named.join(labels, "node"), "labelled")
        if k:
            found = saved(alike(branches(labelled), percent, region, least_depth), "candidates")
        pairs = chosen(found)
        pairs = saved(pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti"), "pairs")
        links = saved(confirmed(pairs, texts, shingle, percent), "links")
        seen = pairs if seen is None else seen.union(pairs)
        if links.isEmpty():
            break
        labels = merged(labels, links)
    # The rest: every pair that shares a bucket and still lies in two components.
    everyone = saved(nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    opened = saved(open_nodes(everyone, percent, wide_region, least_depth), "open-nodes")
    some = everyone.join(opened.select("node").distinct(), "node")
    sets = saved(node_sets(node_texts(docs, some, id_col, text_col), shingle), "open-sets")
    final = merged(everyone.select("node", "label"), block_links(opened, everyone, sets, percent, least_depth))
    of_node = nodes.select("node", "least").join(final, "node")
    least = of_node.groupBy("label").agg(F.min("least").alias("component"))
    component = saved(of_node.join(least, "label").select("node", "component"), "components")
    linked = rows.where("node is not null").join(component, "node").select(id_col, "n_shingles", F.col("component").alias("component_id"))
    empty = rows.where("node is null").select(id_col, "n_shingles", F.col(id_col).alias("component_id"))
    return linked.union(empty).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` with the components joined that ``links`` connect."""
    of_a = labels.select(F.col("node").alias("a"), F.col("label").alias("x"))
    of_b = labels.select(F.col("node").alias("b"), F.col("label").alias("y"))
    roots = connected(links.join(of_a, "a").join(of_b, "b").select(F.col("x").alias("a"), F.col("y").alias("b")))
    renamed = roots.select(F.col("node").alias("label"), F.col("label").alias("to"))
    return labels.join(renamed, "label", "left").select("node", F.coalesce("to", "label").alias("label"))


def named_row(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("string"), F.lit("null"))


def node_texts(docs: DataFrame, named: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node and the text of one of its documents, for each node in ``named``."""
    text = F.col(text_col).cast("string")
    present = docs.select(named_row(id_col).alias("of"), F.xxhash64(text).alias("tag"), text.alias("text"))
    return present.join(named.select("of", "tag", "node"), ["of", "tag"]).groupBy("of", "tag", "node").agg(F.first("text").alias("text")).select("node", "text")
