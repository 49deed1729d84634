"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, langid, line_dedup, minhash, mixing, quality, quality_classifier, runs, substring_dedup, token_files, warc, whitening
from .store import small_batches

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(_table(spark, sf_dir, "documents"))


def op2_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), vocabulary())


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_tokens(spark, _table(spark, sf_dir, "documents"), vocabulary())
    return token_files.read_tokens(files)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_all(spark, _table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op6_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"))


def op7_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(_table(spark, sf_dir, "documents"))


def op8_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.archive(spark, _table(spark, sf_dir, "pages"))
    return warc.read_archives(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
    return quality.judged(_table(spark, sf_dir, "documents")).select(*columns)


def op10_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), minhash.Plan(width=3, percent=85))


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(_table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.predict_all(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_bpe_encode": op2_bpe_encode,
    "op3_token_files": op3_token_files,
    "op4_language_id": op4_language_id,
    "op5_mix_sources": op5_mix_sources,
    "op6_nearest_vectors": op6_nearest_vectors,
    "op7_line_spread": op7_line_spread,
    "op8_warc_archive": op8_warc_archive,
    "op9_quality_outliers": op9_quality_outliers,
    "op10_bbit_minhash": op10_bbit_minhash,
    "op11_word_runs": op11_word_runs,
    "op12_whitening": op12_whitening,
    "op13_quality_classifier": op13_quality_classifier,
}

ORACLE_SQL: dict[str, str] = {
    "op5_mix_sources": mixing.MIX_SQL.format(docs="documents"),
    "op7_line_spread": line_dedup.SPREAD_SQL.format(docs="documents", least=10),
    "op8_warc_archive": warc.ARCHIVE_SQL.format(pages="pages"),
}
