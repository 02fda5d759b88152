"""The corpus pipeline: STAGES over documents, each written as Parquet and read again by the next.

All stages but the last return the columns of documents. A later stage has no oracle: learned models, edit distances
and tokenizers are beyond SQL, so tests/llm compares run() with a brute-force version of its exact stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.decontamination import find_items
from attesta.llm.language_id import keep_identified, learn
from attesta.llm.mixing import poisson_mix
from attesta.llm.ngram_join import row_components
from attesta.llm.shared import Scratch
from attesta.llm.token_files import encode_documents, production_tokenizer


def identify_language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; those without letters, or that no language fits, go. A missing lang is filled in."""
    return keep_identified(docs, learn(docs))


def drop_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates; of repeated rows one. Rows that share an id go by their own texts. Rows without an id stay."""
    found = row_components(docs).where("component_id = doc_id")
    alone = F.col("link_id").isNull()
    # of linked texts under one id, one
    first = found.groupBy("doc_id", "link_id", F.when(alone, F.col("row"))).agg(F.min("row").alias("first_row")).select(F.col("doc_id").alias("first_id"), "first_row")
    # dealt by id and row once: repeated rows are then in one place
    kept = docs.withColumn("_row", F.xxhash64("text")).join(first.hint("merge"), (F.col("doc_id") == F.col("first_id")) & (F.col("_row") == F.col("first_row")), "left_semi")
    kept = kept.dropDuplicates(["doc_id", "_row", "text"]).select(docs.columns)
    return kept.unionByName(docs.where("doc_id is null")).select(docs.columns)


def drop_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, not even with a tenth of its characters edited; each row by its own text, with an id or without."""
    row = F.xxhash64("doc_id", "text")
    keyed = docs.select(row.alias("row"), "text")
    found = find_items(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="row").select(F.col("doc_id").alias("found_row")).distinct()
    return docs.join(found, row == F.col("found_row"), "left_anti").select(docs.columns)


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as drawn for its source."""
    return poisson_mix(docs).select(docs.columns)


def write_tokens(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read back from the token files."""
    return encode_documents(docs, production_tokenizer())


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("poisson_mix", mix_sources),
    ("token_files", write_tokens),
]

ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
