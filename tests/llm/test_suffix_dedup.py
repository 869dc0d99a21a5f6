"""Removed repeats against a plain index of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from pantrylens.llm import suffix_dedup
from pantrylens.llm.bwt_intervals import shared_prefix_groups


def plain(rows, least):
    owner = {}
    big = 1 << 62
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for k in range(len(b) - least + 1):
            w = b[k : k + least]
            owner[w] = min(owner.get(w, big), big if i is None else i)
    out = Counter()
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - least + 1):
            if owner[b[k : k + least]] < (big if i is None else i):
                gone[k : k + least] = b"\1" * least
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b)))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def run(df, **k):
    got = suffix_dedup.remove_repeats(df, **k).collect()
    for r in got:
        assert sum(b - a for a, b in r.spans) == r.n_removed and len(r.spans) == r.n_spans
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got)


def test_interval_search():
    rng = random.Random(1)
    for _ in range(60):
        least = rng.choice([1, 2, 3, 5, 8])
        alphabet = rng.choice([b"ab", b"abc", b"abcdefgh"])
        parts = [bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 12))]
        parts += parts[: rng.randint(0, 1)]
        flat = np.concatenate([np.r_[np.frombuffer(p, np.uint8).astype(np.int32) + 1, 0] for p in parts])
        order, group = shared_prefix_groups(flat, least)
        valid, at = {}, 0
        for p in parts:
            valid |= {at + k: p[k : k + least] for k in range(len(p) - least + 1)}
            at += len(p) + 1
        by = {}
        for p, g in zip(order.tolist(), group.tolist()):
            if p in valid:
                by.setdefault(g, set()).add(valid[p])
        assert all(len(v) == 1 for v in by.values()) and len(by) == len(set(valid.values()))


@pytest.mark.parametrize("hot", [5000, 1])
def test_edge_documents(hot, docs, no_docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_TEXTS", hot)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert run(docs) == plain(rows, 50)
    assert run(docs, least=30) == plain(rows, 30)
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


@pytest.mark.parametrize("hot", [5000, 3])
def test_shared_passages(hot, spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_TEXTS", hot)
    rng = random.Random(7)
    make = lambda n: "".join(rng.choice("abcdé 日\n") for _ in range(n))
    passages = [make(rng.choice([20, 45, 49, 50, 51, 90, 400])) for _ in range(12)]
    rows = []
    for i in range(150):
        text = "".join(rng.choice([make(rng.randint(0, 60)), rng.choice(passages)]) for _ in range(rng.randint(0, 8)))
        rows.append((i, text))
        if rng.random() < 0.2:
            rows.append((1000 + i, text))
        if rng.random() < 0.1:
            rows.append((i, rng.choice([text, make(80)])))
    rows += [(2000, "x" * 3000), (2001, "x" * 70), (None, passages[-1] * 2), (None, passages[-1] + "z")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert run(df) == plain(rows, 50)


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert run(df) == plain([(r.doc_id, r.text) for r in df.collect()], 50)
