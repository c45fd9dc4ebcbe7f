"""A corpus from raw documents to packed sequences: five stages, each written and read again.

All stages take and give rows with the columns of documents, but for the last, which gives pieces of sequences. Extra columns, whatever
their names, go through the first four unchanged. An empty table stays empty throughout.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loadloom.llm import decontaminate, line_dedup, packing, quality_rules, simhash
from loadloom.llm.common import shared_table, tables


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. Null, empty and very short texts (under 50 words) are rejected, whatever their id; repeated rows are judged
    alike; very long texts are judged whole."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines leave the texts; all rows stay, also those whose text becomes empty. Null texts stay null, null sources are no
    site, null ids and repeated rows are treated like any other row."""
    return line_dedup.clean_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id (ties: the smallest hash of the text; repeated rows: one). Null and
    empty texts are one group; a row with a null id stays only if its group has no other."""
    return simhash.keep_first(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark items go. Null and empty texts are clean; rows that share id and text share the verdict; null
    items and those without words hit nothing."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences, one row for each piece. Null texts count as empty, so only their end is packed; null ids and repeated
    rows are packed like any other; very long texts lie in several sequences."""
    return packing.curve_pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", contamination),
    ("packing", packed),
]
#: Estimated accuracies, fingerprints and tokens are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the stages make of the documents of ``sf_dir``. A stage's tables are dropped once its result is written, and the
    result of the stage before it too; those of the last stage remain, as its rows are read from them."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    with tables(spark) as run_tables:
        for name, stage in STAGES[:-1]:
            with tables(spark) as own:
                docs = shared_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
                own.keep(own.paths[-1])
            if before:
                run_tables.drop(before)
            before = run_tables.paths[-1]
        docs = STAGES[-1][1](spark, docs, sf_dir)
        for path in run_tables.paths:
            run_tables.keep(path)
    return docs
