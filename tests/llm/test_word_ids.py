"""Ids of words by the parts of a word, against the tokenizer on whole texts."""

import random

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

from pantrylens.llm import packing
from pantrylens.llm.queries import vocabulary_path

PATH = vocabulary_path("word_bpe_49k.json")
ODD = [
    "it's. dogs' a'' b 'tis 's 's. 'LL. they'll,",
    "x.é y…. z…, naïve! straße. ß! ΑΣ. ς! Σ, ǅ. İ. K.",
    "<|endoftext|>. A<|startoftext|>, B. <|endoftext |>. a<|b.",
    "1.5, 2. 1st. 2nd, 3'rd a_b_ _ ..s.. #tag!!! x\x00. \x01 a\x7f. ́a. 日本語。 日本語.",
    "the the, the. The THE! cat cat.",
]


def ids_of(known: packing.WordIds, text: str) -> list[int]:
    words = packing.words_of(text.encode())
    ids = known.of(set(words))
    return np.frombuffer(b"".join(map(ids.__getitem__, words)), dtype=known.kind).tolist()


def test_words_in_parts_have_the_tokenizers_ids(monkeypatch):
    rnd = random.Random(3)
    texts = ODD + ["".join(rnd.choice("aAbe0 .,'\"é…!<|>s tlĹ _-") for _ in range(80)) for _ in range(300)]
    for most in (packing.CACHE_WORDS, 5):
        monkeypatch.setattr(packing, "CACHE_WORDS", most)
        known = packing.WordIds(PATH)
        for text in texts:
            assert ids_of(known, text) == known.tokenizer.encode(text, add_special_tokens=False).ids


def test_frequent_words_outlast_a_full_cache(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 50)
    known = packing.WordIds(PATH)
    asked = []
    encode = known._encode
    monkeypatch.setattr(known, "_encode", lambda words: (asked.extend(words), encode(words))[1])
    for k in range(40):
        known.of({b"the", b"the.", *(f"rare{chr(97 + k % 26)}{chr(97 + j)}{'x' * k}".encode() for j in range(20))})
        assert len(known.ids) + len(known.before) <= 2 * (50 + 23)
    assert asked.count(b"the") == 1 and asked.count(b"the.") == 0


def test_a_task_leaves_no_words_behind(monkeypatch):
    class Plain:
        dtypes = [("doc_id", "bigint"), ("text", "string")]
        select = lambda self, *columns: self
        mapInArrow = lambda self, run, schema: run

    monkeypatch.setattr(TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    run = packing.tokenize(Plain(), PATH)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["the cat", None])], names=["doc_id", "text"])
    assert sum(b.num_rows for b in run(iter([batch]))) == 2
    assert not packing.word_ids(PATH).ids and not packing.word_ids(PATH).before
