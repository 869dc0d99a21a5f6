"""SimHash groups against all pairs of fingerprints."""

import random
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from pantrylens.llm import gray_index, queries
from pantrylens.llm.shared import mixed

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_fingerprint(text, size=3):
    words = WORD.findall((text or "").encode().lower())
    if len(words) < size:
        spans = [b" ".join(words)] if words else []
    else:
        spans = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in spans]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(codes, limit):
    """For each code its least component member's place, by comparing every pair."""
    codes = np.array(codes, dtype=np.uint64)
    root = list(range(len(codes)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes[i + 1 :] ^ codes[i]) <= limit).tolist():
            a, b = find(i), find(i + 1 + j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


def plain(rows):
    codes = [plain_fingerprint(t) for _, t in rows]
    place = plain_components(codes, 2)
    least = {}
    for (i, _), p in zip(rows, place):
        if i is not None:
            least[p] = min(least.get(p, i), i)
    return Counter((i, f"{c:016x}", least.get(p)) for (i, _), c, p in zip(rows, codes, place))


def run(df, **k):
    out = gray_index.near_fingerprints(df, **k).collect()
    return Counter((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in out)


def test_gray_neighbours_differ_in_one_bit():
    codes = np.arange(1 << 12, dtype=np.uint64)
    by_rank = codes[np.argsort(gray_index.gray_rank(codes))]
    assert (np.bitwise_count(by_rank[1:] ^ by_rank[:-1]) == 1).all()


def test_search_finds_all_within_the_limit():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 64, 40, dtype=np.uint64)
    near = base[rng.integers(0, 40, 900)] ^ (np.uint64(1) << rng.integers(0, 64, 900, dtype=np.uint64))
    codes = np.unique(np.r_[base, near, np.arange(70, dtype=np.uint64)])
    codes = codes[np.argsort(gray_index.gray_rank(codes))]
    index = gray_index.GrayIndex(codes, codes)
    for limit in (0, 1, 2, 5):
        got = {(q, d) for qs, ds in index.search(codes, limit) for q, d in zip(qs.tolist(), ds.tolist())}
        want = np.argwhere(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= limit)
        assert got == {tuple(x) for x in want.tolist()}


def test_edge_documents(spark, docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert run(docs) == plain(rows)
    assert run(docs, least_groups=1) == plain(rows)
    assert gray_index.near_fingerprints(no_docs).count() == 0


def test_dense_groups_in_many_slices(spark):
    """A ball of codes round one centre, a chain in label order of 2000 and random codes; small groups and slices."""
    rng = random.Random(12)
    codes = {rng.getrandbits(64) for _ in range(600)}
    centre = rng.getrandbits(64)
    for _ in range(1500):
        code = centre
        for b in rng.sample(range(64), rng.randint(0, 5)):
            code ^= 1 << b
        codes.add(code)
    chain = 0
    for k in range(2000):
        codes.add((0xABCDE << 44) | (k ^ k >> 1))
    codes = sorted(codes)
    array = np.array(codes, dtype=np.uint64)
    rank = gray_index.in_order(gray_index.gray_rank(array))
    nodes = spark.createDataFrame([(int(c), int(r)) for c, r in zip(array.view(np.int64), rank)], "fp long, rank long").repartition(4)
    links = gray_index.links(nodes, 2, group_size=50, slice_size=40).collect()
    assert len(links) <= 20 * len(codes)
    back = {int(n): i for i, n in enumerate(mixed(array).view(np.int64))}
    root = list(range(len(codes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in links:
        a, b = find(back[r.a]), find(back[r.b])
        root[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(codes))] == plain_components(codes, 2)


def test_long_text_without_spaces_and_with(spark):
    rows = [(0, "z" * 20_000_000), (1, "ab cd " * 300_000), (2, "ab cd " * 300_001), (3, "Z" * 20_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.component_id for r in gray_index.near_fingerprints(df).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 0}


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = queries.op12_gray_index(spark, sf_dir)
    assert got.dtypes == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert Counter(tuple(r) for r in got.collect()) == plain(rows)
    # the hash is Spark's own xxhash64 of the text, whose seed is 42
    short = spark.createDataFrame([("one two three",)], "text string").select(F.hex(F.xxhash64("text"))).first()[0]
    assert short.lower().zfill(16) == f"{plain_fingerprint('one two three'):016x}"
