"""Small documents with the cases that every text operator must define."""

import pytest

LONG = "longword" * 4000
DOCS = [
    (0, "The cat sat on the mat. It was warm.\nThe dog barked at the cat, and the cat ran away from the dog at once. Then it slept."),
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "one"),
    (5, "A▁b  c\n\n日本語 text é ☃ <0x41> end"),
    (6, "The cat sat on the mat. It was warm.\nThe dog barked at the cat, and the cat ran away from the dog at once. Then it slept."),
    (7, LONG),
    (8, "a " * 50),
    (9, "spam ham | " * 30 + "\nBuy now!! BUY NOW!! BUY!!"),
    (10, "word " * 30 + "\n" + "word " * 30 + "\nend."),
    (None, "a text without an id. It has a few words in two short sentences."),
    (11, None),
    (11, None),
]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, "en", None, 7, "x") for i, t in DOCS]
    schema = "doc_id long, text string, lang string, score double, n_words long, ids string"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")
