"""Queries of the problems on texts, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapemill.llm import encodings, mixture, packing


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document in containers of each capacity."""
    return packing.pack(_t(spark, d, "documents"), _t(spark, d, "container_specs"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill(p8_containers(spark, d))


def p8_sound(spark: SparkSession, d: str) -> DataFrame:
    """Whether every document is in a container, none overfull and none cut needlessly."""
    return packing.soundness(p8_containers(spark, d), _t(spark, d, "documents"), _t(spark, d, "container_specs"))


def p8_likeness(spark: SparkSession, d: str) -> DataFrame:
    """How alike the documents of a container are, beside any documents."""
    return packing.likeness(p8_containers(spark, d), _t(spark, d, "documents"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixture's blocks with their tokens."""
    return mixture.mix(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached."""
    return mixture.shares(p9_mixture(spark, d), _t(spark, d, "mix_targets"))


def p9_held(spark: SparkSession, d: str) -> DataFrame:
    """Whether caps and shares are kept."""
    return mixture.held(p9_shares(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return encodings.restored(_t(spark, d, "documents")).select("doc_id")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    """The affected documents with their text restored."""
    return encodings.restored(_t(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p8_containers, p8_fill, p8_sound, p8_likeness, p9_mixture, p9_shares, p9_held, p10_found, p10_restored)}
#: The others cannot be said in SQL: a tokenizer, a packing, a draw, a compressor. These are what must hold of them.
SQL: dict[str, str] = {
    "p8_sound": "select spec_id, capacity_tokens, (select count(distinct doc_id) from documents) as documents, 0::bigint as lost, 0::bigint as overfull, 0::bigint as cut_needlessly from container_specs where capacity_tokens > 0",
    "p9_held": "select source, target_share, max_repeats, true as capped, true as shared from mix_targets",
}
