"""Near-duplicate groups against all pairs."""

import random
import re
from collections import Counter

import pytest

from pantrylens.llm import lsh_forest

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_set(text, size):
    words = WORD.findall((text or "").encode().lower())
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def plain(rows, size, percent=80):
    """Counter of (id, n_shingles, component_id, kept) by comparing every pair of different sets."""
    sets = [shingle_set(t, size) for _, t in rows]
    distinct = sorted({s for s in sets if s}, key=len)
    root = {s: s for s in distinct}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for k, a in enumerate(distinct):
        for b in distinct[k + 1 :]:
            if 100 * len(a) < percent * len(b):
                break
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                root[find(a)] = find(b)
    least = {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            r = find(s)
            least[r] = min(least.get(r, i), i)
    out = Counter()
    for (i, _), s in zip(rows, sets):
        c = least.get(find(s)) if s else i
        out[i, len(s), c, i == c] += 1
    return out


def run(df, **k):
    rows = lsh_forest.near_duplicates(df, **k).collect()
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows)


@pytest.mark.parametrize("size", [2, 5])
def test_edge_documents(size, spark, docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert run(docs, shingle=size) == plain(rows, size)
    assert lsh_forest.near_duplicates(no_docs, shingle=size).count() == 0


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert run(df, shingle=2) == plain([(r.doc_id, r.text) for r in df.collect()], 2)


def test_large_and_borderline_groups(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    rows = []
    for group in range(25):
        base = [word() for _ in range(rng.choice([4, 12, 60, 200]))]
        for _ in range(rng.choice([2, 5, 150])):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 15))):
                text[rng.randrange(len(text))] = word()
            rows.append((len(rows), " ".join(text)))
            if rng.random() < 0.3:
                rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert run(df, shingle=2) == plain(rows, 2)
    assert run(df, shingle=2, region=6, wide_region=200) == plain(rows, 2)


def edited_group(rng, n, words, most):
    """Texts that are one base with up to ``most`` words replaced: near pairs, and many that are just not."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    base = [word() for _ in range(words)]
    for _ in range(n):
        text = list(base)
        for k in rng.sample(range(words), rng.randint(1, most)):
            text[k] = word()
        yield " ".join(text)


@pytest.mark.parametrize("limits", [{}, {"region": 4, "wide_region": 40, "rounds": 1}])
def test_group_of_more_texts_than_a_region(limits, spark):
    """A large group, and a chain in which each text is near to the next one only."""
    rng = random.Random(11)
    rows = list(enumerate(edited_group(rng, 1300, 60, 6)))
    chain = ["".join(rng.choice("klmnopqrst") for _ in range(5)) for _ in range(5000)]
    rows += [(5000 + k, " ".join(chain[4 * k : 4 * k + 40])) for k in range(1200)]
    want = plain(rows, 2)
    assert len({c for _, _, c, _ in want}) > 20
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert run(df, shingle=2, **limits) == want


def test_clashing_names_and_a_very_long_text(spark):
    """Extra columns with the operator's own names, and 20 MB without white space, and 2 MB with."""
    words = " ".join(f"w{k % 7919}" for k in range(300_000))
    rows = [(1, words), (2, words + " end"), (3, "x" * 20_000_000), (4, "y z"), (5, "Y  Z")]
    plainly = spark.createDataFrame(rows, "doc_id long, text string")
    names = ["node", "tag", "sig", "label", "n", "n_shingles", "component_id", "kept"]
    df = plainly.selectExpr("*", *[f"'clash' AS {c}" for c in names])
    assert run(df, shingle=2) == plain(rows, 2)
