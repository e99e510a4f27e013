"""Lookups that stay even when a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key is hot from one in this many rows; so there are at most this many hot keys, which bounds their broadcast.
HOT_SHARE = 1000


def lookup(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """``rows`` left-joined to ``table`` on ``key`` (unique in ``table``), hot keys by broadcast.

    ``weight`` is the column of ``table`` with the number of rows that carry the key; it is dropped from the result.
    Keys with at least a thousandth of all rows are at most a thousand: their entries are broadcast, and their rows never
    enter the shuffle. All other rows take an ordinary join. Null keys stay without a match and are not shuffled.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    edge = max(1.0, total / HOT_SHARE)
    names = [c for c in table.columns if c not in (key, weight)]
    hot = table.where(F.col(weight) >= edge).select(key, *names, F.lit(True).alias("_hot"))
    cold = table.where(F.col(weight) < edge).select(key, *names)
    first = rows.join(F.broadcast(hot), key, "left")
    done = first.where(F.col("_hot") | F.col(key).isNull()).drop("_hot")
    rest = first.where(F.col("_hot").isNull() & F.col(key).isNotNull()).select(*rows.columns).join(cold, key, "left")
    order = [*rows.columns, *names]
    return done.select(*order).union(rest.select(*order))
