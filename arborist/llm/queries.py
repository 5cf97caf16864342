"""The corpus operators as registered queries: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborist.llm import chat, decontaminate, html, licences, packing, quality, sentences, sharding, simhash, suffixes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_html_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(table(spark, sf_dir, "pages"))
    text = F.array_join("blocks", " ")
    return found.select("page_id", "url", text.alias("text"), F.char_length(text).cast("bigint").alias("n_chars"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


def packed(docs: DataFrame) -> DataFrame:
    """Documents packed as op1 returns them."""
    import public_tokenizers

    made = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    slim = made.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(slim, docs.count())


def op1_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    # exact copies count as one document, or the lines of every large group of copies would be boilerplate
    return quality.judge(table(spark, sf_dir, "documents"), copies=False).drop("clean_text")


def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentences.dedup(docs, extend=True).withColumnRenamed("clean_text", "text")


def op6_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repaired(table(spark, sf_dir, "conversations"))


def op7_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents"), leaves=24)
    return found.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents"))
    names = lambda *cols: F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.transform(c, lambda s: s["label"]) for c in cols]))), ",")
    starts = F.transform("base", lambda s: s["start"])
    return found.select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names("base").alias("base_labels"), names("base", "spans").alias("labels"),
        F.coalesce(F.array_max(F.transform(F.concat("base", "spans"), lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )


def op10_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit": op1_best_fit,
    "op2_quality": op2_quality,
    "op3_html_field": op3_html_field,
    "op4_simhash": op4_simhash,
    "op5_sentence_spans": op5_sentence_spans,
    "op6_role_repair": op6_role_repair,
    "op7_kd_shards": op7_kd_shards,
    "op8_decontaminate": op8_decontaminate,
    "op9_licences": op9_licences,
    "op10_suffix_arrays": op10_suffix_arrays,
}

ORACLES: dict[str, str] = {
    "op2_quality": quality.SQL,
    "op8_decontaminate": decontaminate.SQL,
}
