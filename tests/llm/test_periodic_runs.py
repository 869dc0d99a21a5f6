"""Runs of repeated words against all periods and all stretches."""

import hashlib
import random
import re
import zlib
from collections import Counter


from pantrylens.llm import periodic_runs, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    """(start, period, length) of every run, by looking at each period and stretch."""
    found, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                found.setdefault((i, length), q)
            i = j + 1
    return sorted((s, q, length) for (s, length), q in found.items())


def collapse(words, runs):
    gone = {i for s, q, length in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def plain(rows):
    out = Counter()
    for i, text in rows:
        words = WORD.findall(text or "")
        runs = plain_runs(words)
        out[i, len(words), tuple(runs), collapse(words, runs)] += 1
    return out


def run(df, **k):
    rows = periodic_runs.periodic_runs(df, **k).collect()
    return Counter((r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs), r.collapsed) for r in rows)


def repeated_texts(rng, n):
    """Texts of few words with powers of short and long blocks in them, some nested, some touching."""
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 5)):
            block = [rng.choice("abc") for _ in range(rng.choice([1, 1, 2, 3, 5, 9, 17, 40]))]
            if rng.random() < 0.3:
                block = (block * rng.randint(3, 6))[: rng.randint(4, 40)] + [rng.choice("xyz")]
            words += (block * rng.randint(1, 9))[: rng.randint(1, 400)]
            words += [rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))]
        yield i, rng.choice([" ", "\n", " \t "]).join(words)


def test_edge_documents(spark, docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert run(docs) == plain(rows)
    assert run(docs, tile=8) == plain(rows)
    assert periodic_runs.periodic_runs(no_docs).count() == 0


def test_runs_at_any_tile_size(spark):
    rng = random.Random(13)
    rows = list(repeated_texts(rng, 300))
    rows += [(1000, "a " * 3000), (1001, ("a b " * 9 + "c ") * 120), (1002, " ".join(bin(i).count("1") % 2 * "x" + "y" for i in range(4096)))]
    rows += [(1003, rows[5][1]), (1003, rows[5][1]), (1003, rows[6][1]), (None, rows[7][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = plain(rows)
    assert sum(len(k[2]) for k in want) > 500
    assert run(df) == want
    assert run(df, tile=64) == want
    assert run(df, tile=7) == want


def test_very_long_texts(spark):
    rows = [(0, "x" * 20_000_000), (1, "ab c " * 400_000), (2, " ".join(str(i * i % 999_983) for i in range(300_000)) + " tail" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in periodic_runs.periodic_runs(df).collect()}
    assert got[0].n_words == 1 and got[0].runs == [] and len(got[0].collapsed) == 20_000_000
    assert [tuple(x) for x in got[1].runs] == [(0, 2, 800_000)] and got[1].collapsed == "ab c"
    assert [tuple(x) for x in got[2].runs] == [(300_000, 1, 50_000)] and got[2].collapsed.endswith(" tail")


def plain_digest(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    best = (None, None, None, None)
    for s, q, length in runs:
        if best[0] is None or length * best[2] > best[1] * q:
            best = (s, length, q, 1000 * length // q)
    lines = "".join(f"{s},{length},{q}\n" for s, q, length in runs)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, sha(lines), sha(collapse(words, runs)))


def test_query(spark, sf_dir):
    got = queries.op13_periodic_runs(spark, sf_dir)
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert got.columns == names
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = Counter(plain_digest(r.doc_id, r.text) for r in docs)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert sum(w[1] > 0 for w in want) > 10


def test_planted_runs_leave_nulls_alone(spark):
    """Ids of every remainder, with null, empty and blank texts."""
    rows = [(i, t) for i in [None, *range(200)] for t in (None, "", " \n ", "a b c d e f g h i j")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = periodic_runs.with_planted_run(df).collect()
    assert [(r.doc_id, r.text) for r in out if not (r.text or "").strip()] == [(i, t) for i, t in rows if not (t or "").strip()]
    assert all(r.text == "a b c d e f g h i j" for r in out if r.doc_id is None and (r.text or "").strip())
    for r in out:
        assert r.doc_id is None or plain_digest(r.doc_id, "a b c d e f g h i j")[1] == len(plain_runs((r.text or "").split())) or not (r.text or "").strip()
