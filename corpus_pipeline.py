"""The corpus pipeline: quality rules, line dedup, near-duplicate classes, a mix of sources, token ids.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame over all rows of
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import bpe, line_dedup, minhash, mixing, quality
from siltstone.llm.queries import vocabulary
from siltstone.llm.store import drop_tables, small_batches, small_or_not, taken_paths, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their cell's estimate reject go; null and blank texts are among them. Equal rows go or stay together. A very long text is counted whole."""
    small_batches(spark)
    return quality.filter_quality(docs)


def clear_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on ten distinct sources or more go; every document stays, with n_chars of what is left. Null texts stay null; a null source is none."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text", "source"))).alias("row")
    cleared = line_dedup.remove_boilerplate(docs.select("doc_id", "text", "source", row))
    own = {"doc_id", "text", "source"}
    return cleared.select(
        *(F.col(c) if c in own else F.length("text").cast("long").alias(c) if c == "n_chars" else F.col("row").getField(c).alias(c) for c in docs.columns)
    )


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, that of smallest id: five-word shingles, a similarity of 0.8 or more.

    Rows of null id, and of blank or null text, stay; rows of one id go or stay together.
    """
    small_batches(spark)
    found = minhash.near_duplicates(docs, minhash.Plan(width=5, percent=80))
    gone = small_or_not(written(found.where(~F.col("kept")).select("doc_id").distinct(), "gone"))
    return docs.join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, from not at all to twice; rows of one id, source and size are taken alike. Null ids, sources and texts are as in the mix; a very long text counts by its words."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row; null text has no ids, a very long one is encoded whole. An empty table gives no rows, here and in every stage."""
    small_batches(spark)
    return bpe.digests(docs, vocabulary())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", clear_lines),
    ("near duplicates", near_duplicates),
    ("mix of sources", mix_sources),
    ("token ids", encode),
]

#: No SQL has the estimates of the first stage, near duplicates or the merges of the last one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written and reread; what a stage wrote for itself goes when its result stands."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with taken_paths() as paths:
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_tables(before + paths[:-1])
        before = paths[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
