"""Running sums and maxima over keys of any size: ranges of rows first, then what each range hands on.

Rows are sorted by key and order into ranges of about equal size, whatever the keys, and written. A window never holds more than a range. A range can
go on with one key only, the last of the range before, so what is handed on is a row a range.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from vocalith.plans.scratch import materialize

RANGE = "_range"


def ranged(rows: DataFrame, by: str, order: list[str], size: int) -> DataFrame:
    """``rows``, written in ranges of about ``size`` by ``by`` and ``order``, with the number of each one's range."""
    count = rows.count()
    parts = max(1, math.ceil(count / size))
    return materialize(rows.repartitionByRange(parts, by, *order).withColumn(RANGE, F.spark_partition_id()), "ranged")


def running(rows: DataFrame, by: str, order: list[str], sums: dict[str, Column] = {}, tops: dict[str, Column] = {}) -> DataFrame:  # noqa: B006
    """``rows`` (from ``ranged``) with running sums up to each row, it included, and running maxima of the rows before it, by key."""
    inside = Window.partitionBy(RANGE, by).orderBy(*order)
    upto, before = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow), inside.rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns({k: F.sum(c).over(upto) for k, c in sums.items()} | {k: F.max(c).over(before) for k, c in tops.items()})
    each = rows.groupBy(RANGE, by).agg(*[F.sum(c).alias(f"_{k}") for k, c in sums.items()], *[F.max(c).alias(f"_{k}") for k, c in tops.items()])
    earlier = Window.partitionBy(by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)  # as many rows as the key has ranges
    handed = each.select(RANGE, by, F.row_number().over(Window.partitionBy(by).orderBy(RANGE)).alias("_at"), *[F.sum(f"_{k}").over(earlier).alias(f"_{k}") for k in sums], *[F.max(f"_{k}").over(earlier).alias(f"_{k}") for k in tops])
    met = out.join(handed.where("_at > 1").drop("_at"), [RANGE, by], "left")
    return met.withColumns({k: F.col(k) + F.coalesce(f"_{k}", F.lit(0)) for k in sums} | {k: F.greatest(k, f"_{k}") for k in tops}).drop(*[f"_{k}" for k in [*sums, *tops]])
