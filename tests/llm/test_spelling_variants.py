"""Spelling variants against every pair of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from pantrylens.llm import queries, spelling_variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def plain_words(rows, least=7):
    count = Counter()
    for key, text in rows:
        for word in RUN.findall(text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in word)
            if key is not None:
                h = zlib.crc32(f"{key}:{word}".encode())
                if h % 31 == 0:
                    word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= least:
                count[word] += 1
    return {w: n for w, n in count.items() if n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def edits(w, letters):
    """All that one edit can make of a word."""
    for i in range(len(w) + 1):
        yield w[:i] + w[i + 1 :]
        for c in letters:
            yield w[:i] + c + w[i:]
            yield w[:i] + c + w[i + 1 :]


def plain_variants(words):
    out, form = {}, {}
    letters = {c for w in words for c in w}
    for w, n in words.items():
        near = {x for x in edits(w, letters) if x in words and x != w}
        best = min(near, key=lambda x: (-words[x], x.encode()), default=None)
        if best is not None and words[best] >= 10 * n:
            form[w] = best
        out[w] = len(near)
    rows = Counter()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        f = form.get(w)
        rows[w, n, out[w], f, words.get(f), root] += 1
    return rows


def run(df, **k):
    return Counter(tuple(r) for r in spelling_variants.spelling_variants(df, **k).collect())


def test_edge_documents(spark, docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert run(docs) == plain_variants(plain_words(rows))
    assert run(docs, least_letters=4) == plain_variants(plain_words(rows, 4))
    assert spelling_variants.spelling_variants(no_docs).count() == 0


def test_all_neighbours(spark):
    """Words of few letters, so that runs of equal letters and pairs with several ways are common."""
    rng = random.Random(11)
    words = set()
    while len(words) < 1500:
        words.add("".join(rng.choice("abé") for _ in range(rng.randint(7, 10))))
    words |= {"q" * 150 + x + "q" * 250 for x in ("", "a", "b", "ab", "qa", "aq")} | {"q" * 400 + x for x in ("a", "qa")}
    words |= {"a" * k for k in range(7, 30)} | {"ab" * k for k in range(4, 12)}
    words = sorted(words)
    df = spark.createDataFrame([(w, rng.randint(2, 50)) for w in words], "word string, n long").repartition(3)
    got = [(r.word, r.near) for r in spelling_variants.neighbours(df).collect()]
    want = {(a, b) for a in words for b in words if abs(len(a) - len(b)) < 2 and a != b and one_edit(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_forms_ties_and_chains(spark):
    text = "abcdefg " * 2000 + "abcdefgh " * 200 + "abcdefghi " * 20 + "abcdefghij " * 2 + "zbcdefgh " * 200 + "zbcdefghi " * 2
    text += "ÀBCDEFGÿ " * 3 + "àbcdefgÿ " * 30 + "x×÷xxxxx "
    rows = [(None, text), (None, "x×÷xxxxx")]
    got = {r.word: r for r in spelling_variants.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got["abcdefghij"].form == "abcdefghi" and got["abcdefghij"].root == "abcdefg"
    assert got["zbcdefghi"].form == "zbcdefgh" and got["zbcdefgh"].form is None and got["zbcdefgh"].n_near == 2
    assert got["Àbcdefgÿ"].form == "àbcdefgÿ" and got["x×÷xxxxx"].n == 2
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == plain_variants(plain_words(rows))


def test_long_words_and_parameters(spark):
    rows = [(k, "q" * 1_000_000 + "x" * k) for k in (0, 0, 1, 1)]
    got = spelling_variants.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((len(r.word), r.n, r.n_near) for r in got) == sorted(
        (len(w), n, k) for (w, n, k, *_) in plain_long(plain_words(rows))
    )
    with pytest.raises(ValueError):
        spelling_variants.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"), least_letters=3)


def plain_long(words):
    """As plain_variants, for words told apart by their lengths alone."""
    for w, n in words.items():
        yield w, n, sum(abs(len(w) - len(x)) == 1 for x in words)


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = queries.op11_spelling_variants(spark, sf_dir)
    assert got.dtypes == [("word", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form", "string"), ("form_n", "bigint"), ("root", "string")]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = plain_variants(plain_words(rows))
    assert Counter(tuple(r) for r in got.collect()) == want
    assert sum(w[3] is not None for w in want) > 5
