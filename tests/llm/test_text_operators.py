"""Line rules, classifier, packing, token counts and sampled pieces against plain versions."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pantrylens.llm import line_rules, packing, pieces, quadratic, sampled_pieces, token_counts
from pantrylens.llm.queries import QUERIES, vocabulary_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PIECES = "piece_bpe_32k.model"


def repeat_words(words):
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(runs)
    hit = {i + k for i, r in enumerate(runs) if count[r] > 1 for k in range(8)}
    return len(hit)


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, repeat_words(words))


@pytest.mark.parametrize("source", ["docs", "table"])
def test_line_rules_base(source, spark, docs, sf_dir):
    table = docs if source == "docs" else spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = line_rules.clean_lines(table, carry=["lang"]).drop("lang").collect()
    want = Counter((r.doc_id, *base_counts(r.text)) for r in table.collect())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_line_rules_verdicts(docs, no_docs):
    by = {r.doc_id: r for r in line_rules.clean_lines(docs).collect()}
    assert by[0].kept and by[0].n_failed_lines == 0
    assert not by[9].kept and by[9].n_failed_lines == by[9].n_lines
    assert by[1].cleaned_text == "" and not by[1].kept
    assert line_rules.clean_lines(no_docs).count() == 0


def test_line_rules_keep_labelled_good(spark):
    sf = "/root/testdata/sf0.01"
    rules = QUERIES["op6_line_rules"](spark, sf)
    good = rules.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("quality = 1 and not base_failed")
    assert good.where("not kept").count() <= 0.01 * good.count()


def test_classifier_separates(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op8_quadratic"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    right = sum(r.predicted == r.quality for r in held)
    assert right >= 0.95 * len(held)


def test_classifier_edges(spark, docs, no_docs):
    stats = quadratic.text_statistics(docs)
    labels = spark.createDataFrame([(0, 1), (0, 1), (9, 0), (10, 0), (5, 1), (4, None), (8, 0), (8, 1), (7, 5)], "doc_id long, quality int")
    model = quadratic.learn(stats, labels, quadratic.F.lit(True))
    got = quadratic.scored(stats, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    none = quadratic.learn(stats, labels.where("false"), quadratic.F.lit(True))
    assert {r.score for r in quadratic.scored(stats, none).collect()} == {0.5}
    one = quadratic.learn(stats, labels.where("quality = 1"), quadratic.F.lit(True))
    assert {r.score for r in quadratic.scored(stats, one).collect()} == {1.0}
    assert quadratic.scored(quadratic.text_statistics(no_docs), model).count() == 0


def plain_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


SPECIALS = ["a <|endoftext|> b", "A<|endoftext|>B <|ENDOFTEXT|> c<|startoftext|>", "<|Endoftext|> <| x |>"]


@pytest.mark.parametrize("source", ["docs", "table"])
def test_packing(source, spark, docs, sf_dir):
    special = spark.createDataFrame([(100 + k, t, "en", None, 7, "x") for k, t in enumerate(SPECIALS)], docs.schema)
    table = docs.union(special) if source == "docs" else spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3)
    window = 64
    got = packing.pack(table, vocabulary_path("word_bpe_49k.json"), window=window).collect()
    texts = Counter()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    for s in range(len(by)):
        at = 0
        for r in sorted(by[s], key=lambda r: r.offset):
            assert r.offset == at and len(r.ids) == 4 * r.length
            at += r.length
        assert at == window or s == len(by) - 1
    docs_ids = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        key = (r.doc_id, r.sequence_id * window + r.offset - r.start)
        docs_ids.setdefault(key, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    for (i, _), ids in docs_ids.items():
        texts[i, tuple(ids)] += 1
    assert texts == Counter((r.doc_id, tuple(plain_ids(r.text))) for r in table.collect())


def test_packing_nothing(no_docs):
    assert packing.pack(no_docs, vocabulary_path("word_bpe_49k.json")).count() == 0


def test_token_counts_equal_the_tokenizer(spark, docs, no_docs, sf_dir):
    from tokenizers import Tokenizer, models

    v = pieces.load(vocabulary_path(PIECES))
    usable = [(p, s) for p, s, ok in zip(v.pieces, v.scores, v.normal) if ok]
    low = min(v.scores)
    vocabulary = [("<unk>", low), *[(f"<0x{b:02X}>", low) for b in range(256)], *usable]
    plain = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = table.union(docs.select("doc_id", "text").where("doc_id is null or doc_id not in (5, 7)"))
    got = token_counts.token_counts(rows, vocabulary_path(PIECES)).collect()
    want = Counter((r.doc_id, len(plain.encode((" " + r.text).replace(" ", "▁")).ids) if r.text else 0) for r in rows.collect())
    assert Counter((r.doc_id, r.n_tokens) for r in got) == want
    assert token_counts.token_counts(no_docs, vocabulary_path(PIECES)).count() == 0


def test_token_counts_tie_rule():
    v = pieces.Vocabulary(["▁a", "b", "ab", "a", "▁", "▁ab", "c", "bc"], [-2.0, -1.0, -2.0, -1.0, -1.0, -3.0, -1.0, -2.0], [True] * 8, [])
    count = token_counts.Counter(v)
    assert count(" ab") == (-3.0, 1)  # ▁ab before ▁ a b and ▁a b
    assert count("bc") == (-2.0, 1)
    assert count("☃☃b")[1] == 2  # unknown characters in a row are one token
    v.byte_ids = list(range(256))
    assert token_counts.Counter(v)("☃b")[1] == 4


@pytest.mark.parametrize("temperature", [0.5, 1.0])
def test_sampled_pieces_are_lossless(temperature, spark, docs, no_docs):
    path = vocabulary_path(PIECES)
    for d in (docs, docs.repartition(1)):
        enc = sampled_pieces.encode_sampled(d, path, seed=3, temperature=temperature)
        rows = sampled_pieces.decode(enc, path).collect()
        assert Counter((r.doc_id, r.text or "") for r in rows) == Counter((r.doc_id, r.decoded) for r in rows)
    other = sampled_pieces.encode_sampled(docs.repartition(5), path, seed=3, temperature=temperature).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in other) == Counter((r.doc_id, tuple(r.ids)) for r in rows)
    assert sampled_pieces.encode_sampled(no_docs, path).count() == 0


def test_sampled_pieces_follow_the_posterior():
    v = pieces.Vocabulary(["a", "b", "ab", *[f"<{b}>" for b in range(256)]], [-1.5, -1.2, -2.0] + [0.0] * 256, [True] * 3 + [False] * 256, list(range(3, 259)))
    s = sampled_pieces.Sampler(v, 1.0)
    codes, lo, hi = sampled_pieces.row_codes(["ab"] * 20000)
    keys = sampled_pieces.mixed(np.arange(20000).astype(np.uint64))
    ids, per_row = s.sample(codes, lo, hi, keys)
    whole = np.exp(-2.0) / (np.exp(-2.0) + np.exp(-2.7))
    assert abs((per_row == 1).mean() - whole) < 0.01
