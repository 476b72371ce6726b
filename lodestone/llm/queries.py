"""The queries over the training-data operators, each with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import kd_trees, near_dedup, packing, quality, rp_forest, secrets, segmentations, suffix_dedup, token_files, toxicity
from .common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2, seq_len=4096)


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every 20th vector, by inner product."""
    return rp_forest.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op3_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every text, with inclusion scores, decoded again."""
    return segmentations.sample(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), k=2, seed=1)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every text."""
    return secrets.digest(secrets.find(table(spark, sf_dir, "documents")))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every byte of every text that a 100-byte string covers which also starts earlier."""
    return suffix_dedup.digest(table(spark, sf_dir, "documents"), length=100)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the least id of its near-duplicate class."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_exact_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products of every 50th vector, exactly."""
    return kd_trees.top(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written as block files and read back."""
    return token_files.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every text."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every text."""
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [v for k, v in globals().items() if k.startswith("op") and callable(v)]
    return {f.__name__: f for f in sorted(found, key=lambda f: int(f.__name__[2:].split("_")[0]))}


def oracle_sql() -> dict[str, str]:
    """SQL for what it can express: the integer products of all pairs. The rest are scores, alignments, encodings and packings."""
    x = ", ".join(f"CAST(floor(256 * CAST(embedding[{i}] AS DOUBLE)) AS BIGINT) AS x{i}" for i in range(1, 65))
    product = " + ".join(f"q.x{i} * c.x{i}" for i in range(1, 65))
    whole = "embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0"
    return {
        "op7_exact_top": f"""WITH ints AS (SELECT vec_id, {x} FROM embeddings WHERE vec_id IS NOT NULL AND {whole}),
            scored AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, {product} AS score FROM ints q JOIN ints c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
            SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5"""
    }
