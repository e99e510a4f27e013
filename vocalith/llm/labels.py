"""Labelled rows for the operators that learn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vocalith.plans.scratch import materialize


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(documents: DataFrame, labels: DataFrame, label: str | Column, rows: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Text and label of at most ``rows`` labelled documents that are not held out, the first by a hash of their ids.

    The bound is on label rows, so their ids can be broadcast: the texts are found in one scan without a shuffle. Null ids,
    labels and texts give no row; an id with several labels or texts gives a row for each pair. Where that makes more than
    ``rows`` rows, equal ones count once and the first by hash stay. No labels or no documents: an empty table.
    """
    value = F.col(label) if isinstance(label, str) else label
    chosen = labels.select("doc_id", value.cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out())
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    found = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(chosen), "doc_id")
    found = materialize(found, "sample")
    if found.count() <= rows:
        return found.select("text", "label")
    keyed = found.withColumn("h", F.xxhash64("text"))
    first = keyed.select("doc_id", "label", "h").distinct().orderBy(F.xxhash64("doc_id", "label", "h"), "doc_id", "label", "h").limit(rows)
    return keyed.join(F.broadcast(first), ["doc_id", "label", "h"], "left_semi").dropDuplicates(["doc_id", "label", "h"]).select("text", "label")
