"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trendloom.llm import concurrency, gif, jaccard, language, lines, lz, mixing, packing, pii, quality, suffixes, whitening, winnow
from trendloom.llm.common import documents


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path())


def op2_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz.fingerprint_digest(documents(spark, sf_dir))


def op3_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.media_digest(documents(spark, sf_dir))


def op4_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir), k=4, part=85, of=100)


def op5_suffix_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeat_digest(documents(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_predictions(documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", "text")


#: Stands in for the secret of a real deployment, so that runs agree.
PII_KEY = "trendloom-demonstration-key"


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(documents(spark, sf_dir), PII_KEY)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening_digest(spark, sf_dir)


def op12_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.contamination_digest(spark, sf_dir)


def op13_peak_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concurrency.peak_digest(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_packing": op1_packing, "op2_lz_fingerprint": op2_lz_fingerprint, "op3_gif_media": op3_gif_media, "op4_parity_join": op4_parity_join, "op5_suffix_index": op5_suffix_index, "op6_language_id": op6_language_id, "op7_line_dedup": op7_line_dedup, "op8_mixing": op8_mixing, "op9_quality": op9_quality, "op10_pii": op10_pii, "op11_whitening": op11_whitening, "op12_winnowing": op12_winnowing, "op13_peak_concurrency": op13_peak_concurrency}


def oracle_sql() -> dict[str, str]:
    return {"op8_mixing": mixing.mix_sql(), "op12_winnowing": winnow.contamination_sql(), "op13_peak_concurrency": concurrency.peak_sql()}
