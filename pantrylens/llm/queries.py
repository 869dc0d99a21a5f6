"""Registered queries of the training-data operators, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pantrylens.llm import (
    context_mixing,
    gray_index,
    line_rules,
    lsh_forest,
    packing,
    periodic_runs,
    quadratic,
    sampled_pieces,
    spelling_variants,
    suffix_dedup,
    token_counts,
    voronoi_knn,
    warc,
)
from pantrylens.llm.shared import remainder, saved, scratch_path
from pantrylens.session import pin_utc


def vocabulary_path(name: str) -> str:
    """Where the public tokenizer files are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    pin_utc(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score_texts(table(spark, sf_dir, "documents"), remainder("doc_id", 10) == 0)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_path("piece_bpe_32k.model")
    encoded = sampled_pieces.encode_sampled(table(spark, sf_dir, "documents"), path, seed=1)
    decoded = sampled_pieces.decode(encoded, path)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), same.alias("lossless"), "ids")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archives")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    return warc.read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op6_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.clean_lines(table(spark, sf_dir, "documents")).drop("cleaned_text")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_quadratic(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = saved(quadratic.text_statistics(table(spark, sf_dir, "documents")), "statistics")
    held_out = remainder("doc_id", 4) == 2
    model = quadratic.learn(stats, table(spark, sf_dir, "labels"), ~held_out)
    scores = quadratic.scored(stats, model)
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi_knn.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(table(spark, sf_dir, "documents"))


def op12_gray_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gray_index.near_fingerprints(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_planted_run(table(spark, sf_dir, "documents").select("doc_id", "text"))
    best = periodic_runs.most_repeated(F.col("runs"))
    line = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    found = periodic_runs.periodic_runs(docs).withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {f.__name__: f for f in (op1_context_mixing, op2_suffix_dedup, op3_sampled_pieces, op4_warc, op5_lsh_forest, op6_line_rules, op7_packing, op8_quadratic, op9_voronoi_knn, op10_token_counts, op11_spelling_variants, op12_gray_index, op13_periodic_runs)}

# DuckDB has no CRC-32 function and no RE2-free word split cheaper than this one; only these are expressible.
ORACLES = {
    "op9_voronoi_knn": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings),
 s AS (SELECT q.vec_id AS query_id, d.vec_id, list_dot_product(q.x, d.x)::BIGINT AS score
       FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
    "op4_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages),
 h AS (SELECT *, sha1(html) AS hexa FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
 (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hexa, (5 * (i // 4) + 1)::BIGINT, 5))::BIGINT
    >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1, 1), '' ORDER BY i) FROM range(32) t(i)) AS payload_digest,
 CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM h""",
}
