"""The registered queries of this subpackage: each operator on its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offermatch.llm import (
    bin_completion, curriculum, language, merkle, multi_index, packing, personal_data, perspectives, simhash,
    threshold_join, token_counts, token_files, weak_supervision,
)
from offermatch.llm.blocks import finite
from offermatch.llm.common import table
from offermatch.llm.oracles import SQL  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, TOKENIZER, limit=1024).drop("text")


@query
def op2_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


@query
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.fresh_path(spark)
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, TOKENIZER, end_id=2)
    return token_files.read_token_files(spark, path)


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), TOKENIZER, end_id=0)


@query
def op5_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = weak_supervision.judged(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("quality", 6).alias("quality"), *[f"vote_{rule}" for rule in weak_supervision.RULES])


@query
def op6_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotated(table(spark, sf_dir, "conversations"))


@query
def op7_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = curriculum.rows_in_order(table(spark, sf_dir, "documents"))
    return ordered.select("doc_id", "size", "source_size", "target", "taken", "copies")


@query
def curriculum_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.positions(table(spark, sf_dir, "documents"))


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return personal_data.digest(personal_data.spans_of(docs))


@query
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(table(spark, sf_dir, "documents"))


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").where(finite(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    whole = threshold_join.whole_components(F.col("embedding")).cast("array<double>")
    rows = vectors.select(F.col("vec_id").alias("id"), label.alias("label"), whole.alias("v"))
    return threshold_join.hard_negatives(rows, every=50)


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return merkle.manifest(table(spark, sf_dir, "documents"), altered=(tampered, "text"))


@query
def op13_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_completion.packed_whole(table(spark, sf_dir, "documents"), TOKENIZER, end_id=0)
