"""Top-k search and archives against plain versions."""

import base64
import hashlib
import random

import numpy as np
import pytest

from pantrylens.llm import voronoi_knn, warc


def plain_top(rows, k):
    ok = [(i, [int(np.floor(1024 * float(np.float32(a)))) for a in v]) for i, v in rows if i is not None and v and all(a is not None and np.isfinite(a) for a in v)]
    out = set()
    asked = {}
    for i, v in ok:
        if i % 3 == 0:
            asked[i] = min(asked.get(i, v), v)
    for q, x in asked.items():
        scores = sorted((-sum(a * b for a, b in zip(x, v)), i) for i, v in ok if i != q and len(v) == len(x))
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)}
    return out


@pytest.mark.parametrize("block", [20_000, 40])
def test_top_k(block, spark, monkeypatch):
    monkeypatch.setattr(voronoi_knn, "DATA_BLOCK", block)
    monkeypatch.setattr(voronoi_knn, "QUERY_BLOCK", block)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=4).round(1)]) for i in range(300)]
    rows += [(900 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(120)]
    rows += [(2000, None), (2001, []), (2002, [1.0, None, 0.0, 0.0]), (2004, [float("nan")] * 4), (2007, [float("inf")] * 4), (None, [1.0] * 4), (2010, [1.0, 2.0]), (2013, [2.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string").repartition(4)
    got = voronoi_knn.top_k(df, voronoi_knn.F.col("vec_id") % 3 == 0, k=5)
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == plain_top(rows, 5)
    assert voronoi_knn.top_k(df.where("false"), voronoi_knn.F.col("vec_id") % 3 == 0).count() == 0


def test_warc_rejects_magic_inside_payloads(spark, tmp_path):
    rng = random.Random(1)
    fake = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:777>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(i, f"http://x/{i}", fake * rng.randint(0, 3) + "x" * rng.randint(0, 400) + fake) for i in range(60)]
    rows += [(100, None, None), (101, "a\r\nb", ""), (102, "u", None), (103, "u", "same"), (104, "u", "same"), (105, "u", "é" * 5000), (None, "u", "nobody")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(2)
    warc.write_warc(pages, str(tmp_path / "w"))
    got = warc.read_warc(spark, str(tmp_path / "w"), block=700).collect()
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    want = set()
    for i, _, h in rows:
        body = (h or "").encode()
        revisit = i != (None if top[h or ""] < 0 else top[h or ""])
        want.add((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", top[h or ""] if revisit else None))
    assert {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want
    assert len(got) == len(rows)


def test_warc_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_warc(empty, str(tmp_path / "w"))
    assert warc.read_warc(spark, str(tmp_path / "w")).count() == 0
