"""Corpus preparation: line rules, quality classifier, near-duplicates, repeated passages, packing.

Each stage takes the documents its predecessor kept and returns documents again, the last one pieces of
packed sequences. Defined cases: null texts and empty ones fail the line rules and go; rows that share
an id and a text stay or go together; an empty table gives an empty result of every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pantrylens.llm import line_rules, lsh_forest, packing, quadratic, suffix_dedup
from pantrylens.llm.queries import vocabulary_path
from pantrylens.llm.shared import saved
from pantrylens.session import pin_utc

# None: rules over lines, a fitted classifier and a tokenizer are not expressible in SQL.
ORACLE_SQL = None

#: Documents whose classifier score is below go.
LEAST_SCORE = 0.5


def with_text(df: DataFrame, columns: list[str], text) -> DataFrame:
    """The columns of documents with a new text and its length."""
    new = {"text": text.alias("text"), "n_chars": F.length(text).cast("long").alias("n_chars")}
    return df.select(*[new.get(c, F.col(c)) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines are removed; documents that fail go."""
    carry = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    judged = line_rules.clean_lines(docs, carry=carry)
    return with_text(judged.where("kept"), docs.columns, F.col("cleaned_text"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from all labels, on the documents they were given for."""
    labelled = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quadratic.learn(quadratic.text_statistics(labelled), labels, F.lit(True))
    carry = [c for c in docs.columns if c != "doc_id"]
    scores = quadratic.scored(quadratic.text_statistics(docs, carry=carry), model, "quality_score")
    return scores.where(F.col("quality_score") >= LEAST_SCORE).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id."""
    gone = lsh_forest.near_duplicates(docs).where("not kept")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    ids = saved(gone.select(key.alias("gone_id")).distinct(), "near-duplicates")
    return docs.join(ids, key == F.col("gone_id"), "left_anti")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has too are removed; characters cut in two go as well."""
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    left = suffix_dedup.remove_repeats(docs, carry=carry)
    text = F.col("kept").cast("string")
    whole = F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.make_valid_utf8(text), F.lit("�"), F.lit("")))
    return with_text(left, docs.columns, whole)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, with their ids."""
    return packing.pack(docs, vocabulary_path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("near-duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    pin_utc(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, name.replace(" ", "-"))
    return docs
