"""Scores against plain counts, against the sum of a normalised model, and against the unigram base."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pantrylens.llm import context_mixing as cm
from pantrylens.llm.shared import remainder

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def check_base(rows, got):
    words = lambda t: WORD.findall((t or "").encode().lower()) + [b"\n"]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter()
    for i, t in rows:
        if not out(i):
            c.update(words(t))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t in rows:
        w = words(t)
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        want[i, out(i), len(w), sum(c[x] > 0 for x in w), n, round(base, 6)] += 1
    assert Counter((r[0], r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want


@pytest.mark.parametrize("frequent", [1 << 18, 20])
def test_edge_documents(frequent, docs, no_docs, monkeypatch):
    monkeypatch.setattr(cm, "FREQUENT_WORDS", frequent)
    got = cm.score_texts(docs, remainder("doc_id", 10) == 0).collect()
    check_base([(r.doc_id, r.text) for r in docs.collect()], got)
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert cm.score_texts(no_docs, remainder("doc_id", 10) == 0).count() == 0
    alone = cm.score_texts(docs.where("doc_id = 0"), cm.F.lit(True)).collect()
    assert len(alone) == 1 and np.isfinite(alone[0].score)


def test_held_out_texts_are_predicted(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = cm.score_texts(df, remainder("doc_id", 10) == 0).collect()
    check_base([(r.doc_id, r.text) for r in df.collect()], got)
    held = [r for r in got if r.held_out]
    # The base gives unknown words a share without spelling them, which a true distribution cannot.
    known = [r for r in held if r.n_known >= 0.9 * r.n_tokens]
    assert sum(r.score for r in known) > sum(r.base_score for r in known)
    assert 0 < np.mean([r.bits_per_byte for r in held]) < 3


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    tables = [rng.integers(0, 5, ((1 << b), 2)).astype(float) for b in cm.TABLE_BITS]
    weights, refined = cm.first_weights(), rng.normal(size=(cm.GATES, cm.LEVELS))
    total = 0.0
    for b in range(256):
        s = cm.spell([bytes([b])], np.array([3]))
        x, gate = cm.features(s, np.zeros(1), tables, False)
        st = np.einsum("bni,bni->bn", x, weights[gate])[:, 0]
        st = np.clip(st + refined[gate[:, 0], cm.level(st)], -14, 14)
        total += np.exp(-np.logaddexp(0, np.where(s.bit[:, 0] > 0, -st, st)).sum())
    assert abs(total - 1) < 1e-4


def test_contexts_reach_into_the_word_before():
    """A text's bits have the same slots whether it is spelled in one or as openings and rests of its words."""
    words = [b"salt", b"a", b"of", b"sodium", cm.END]
    kinds = np.full(len(words), 3)
    opened, rest = cm.spell_openings(cm.openings_of(words), kinds), cm.spell_rest(words, kinds)
    stream = bytes(cm.REACH) + b" salt a of sodium \n"
    at = cm.REACH + 1
    for k, w in enumerate(words):
        for place in range(len(w) + (w != cm.END)):
            s = opened if place < cm.OPENING else rest
            j = np.flatnonzero((s.word == k) & (s.place == place))
            assert len(j) == 1
            for order in (1, 2, 3):
                context = np.uint64(sum(stream[at - 1 - i] << (8 * i) for i in range(order)))
                kind = np.uint64(4 * 0xE7037ED1A0B428DB % 2**64) if cm.WITH_KIND[order - 1] else np.uint64(0)
                with np.errstate(over="ignore"):
                    key = cm.mixed(np.array([context * np.uint64(0x9E3779B97F4A7C15) + np.uint64(order) + kind]))
                    slot = cm.mixed(key + np.uint64(1) * np.uint64(0xD1B54A32D192ED03)) & np.uint64((1 << cm.TABLE_BITS[order - 1]) - 1)
                assert s.slots[order - 1][0, j[0]] == slot[0]
            at += 1
    assert at == len(stream)


def test_a_word_is_likelier_after_the_word_it_follows(spark):
    """Words that come as often score by what stands before them."""
    rows = [(k, "alpha one " * 20 + "beta two " * 20) for k in range(1, 60)] + [(1000, "alpha one " * 10), (1001, "alpha two " * 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in cm.score_texts(df, cm.F.col("doc_id") >= 1000).collect()}
    assert got[1000].base_score == got[1001].base_score
    assert got[1000].score > got[1001].score + 1


def test_frequent_words_come_without_a_limit_and_within_their_number(spark, monkeypatch, capsys):
    """Sorting with a limit brings that many rows of every partition to the driver."""
    monkeypatch.setattr(cm, "FREQUENT_WORDS", 5)
    rows = [(b"w%d" % k, 0, False, n, n, True, -1.0) for k, n in enumerate([9, 7, 7, 4, 2, 2, 2, 0])]
    costs = spark.createDataFrame(rows, "word binary, kind int, opens boolean, own long, c long, head boolean, p double")
    some = cm.most_frequent(costs)
    assert sorted(r.c for r in some.collect()) == [4, 7, 7, 9]
    some.explain()
    assert "TakeOrdered" not in (plan := capsys.readouterr().out) and "Limit" not in plan
    tables = cm.Frequent(some.toArrow(), 10.0).tables
    assert tables[0][0][b"w0"] == (9, -1.0, math.log10(9.1 / 10.0)) and not tables[0][1]
    monkeypatch.setattr(cm, "FREQUENT_WORDS", 0)
    assert cm.most_frequent(costs).count() == 0


def group_table(words, rnd):
    rows = sorted({(w, rnd.randrange(cm.KINDS)) for w in words for _ in range(2)}, key=lambda r: (r[0][: cm.SHARD_PREFIX], r[0] + b" "))
    columns = [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int32()), pa.array([rnd.randrange(4) for _ in rows], pa.int64())]
    first = pa.array([r[0][: cm.SHARD_PREFIX] for r in rows], pa.binary())
    return pa.table([*columns, first], names=["word", "kind", "c", "first"])


def any_model():
    rng = np.random.default_rng(1)
    tables = [rng.integers(0, 5, ((1 << b), 2)).astype(float) for b in cm.TABLE_BITS]
    return cm.Model(tables, cm.first_weights(), rng.normal(size=(cm.GATES, cm.LEVELS)))


def test_parts_of_a_group_score_as_the_whole(monkeypatch):
    """Counts of words so far are those of all words that begin alike, wherever a part ends; also with bytes below a space."""
    rnd = random.Random(3)
    words = [("then" + "".join(rnd.choice("ab\x01!\xe9z") for _ in range(rnd.randint(0, 7)))).encode() for _ in range(300)]
    rows = group_table([*words, b"the", b"\n", *(b"x" * 90 + bytes([97 + k]) for k in range(3))], rnd)
    model, found = any_model(), []
    for size, long in ((1 << 30, 1 << 30), (400, 20), (1, 5)):
        monkeypatch.setattr(cm, "SPELLED_BYTES", size)
        monkeypatch.setattr(cm, "LONG_WORD", long)
        parts = list(cm.group_parts(rows))
        assert [w for p in parts for w in p.words] == rows["word"].to_pylist()
        found.append((len(parts), np.concatenate([model.log10(p) for p in parts])))
    assert found[0][0] == 1 and found[1][0] > 10 and found[2][0] > 200
    assert np.allclose(found[0][1], found[1][1], atol=1e-9) and np.allclose(found[0][1], found[2][1], atol=1e-9)


def test_a_large_group_takes_little_memory():
    """All words with the same first bytes are of one task: they are spelled some at a time."""
    rnd = random.Random(4)
    rows = group_table([b"page%d" % rnd.randrange(10**12) for _ in range(12_000)], rnd)
    model = any_model()
    assert len(list(cm.groups(iter(rows.to_batches(5_000))))) == 1
    tracemalloc.start()
    try:
        n = sum(len(model.log10(p)) for p in cm.group_parts(rows))
        assert n == rows.num_rows > 20_000 and tracemalloc.get_traced_memory()[1] < 150e6
    finally:
        tracemalloc.stop()
