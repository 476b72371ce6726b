"""Labelled rows to learn from: which are held out, and a bounded sample of the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents of each class that a classifier is fitted on, at most.
PER_CLASS = 2000


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls on the held-out remainder; rows without an id are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, target: str, *, folds: int, fold: int, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> tuple[DataFrame, float]:
    """(doc_id, label, text) of at most per_class rows of each label that are not held out, by hash of the id; the share of label 1 among all such labels.

    Ids with contrary labels count as 1, and of an id that repeats the least
    text is taken, so that ids and rows are bounded alike. The ids (per_class
    of each label) are few enough to broadcast.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(target).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.where(~held_out("doc_id", folds, fold)).groupBy("doc_id").agg(F.max("label").alias("label"))
    share = known.agg(F.avg("label")).first()[0]
    chosen = None
    for value in (0, 1):
        own = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = own if chosen is None else chosen.unionByName(own)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return rows, 0.5 if share is None else float(share)
