"""Dataset reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def totals(rows: DataFrame, duration: str, accepted: Column) -> DataFrame:
    """One row: clips and hours, total, accepted and rejected, and mean durations."""
    d = F.col(duration)
    hours = lambda c: F.coalesce(F.sum(F.when(c, d)), F.lit(0.0)) / 3600
    return rows.agg(
        F.count("*").alias("clips"), F.count_if(accepted).alias("accepted"), F.count_if(~accepted).alias("rejected"), (F.sum(d) / 3600).alias("hours"),
        hours(accepted).alias("accepted_hours"), hours(~accepted).alias("rejected_hours"), F.avg(d).alias("mean_s"), F.avg(F.when(accepted, d)).alias("accepted_mean_s"),
    )


def by_reason(rows: DataFrame, reasons: str, duration: str) -> DataFrame:
    """Clips and hours by reason; a clip counts under each of its reasons."""
    return rows.select(F.explode(reasons).alias("reason"), duration).groupBy("reason").agg(F.count("*").alias("clips"), (F.sum(duration) / 3600).alias("hours"))


def by_group(rows: DataFrame, key: str, duration: str, accepted: Column) -> DataFrame:
    """Clips and hours by a key, null as ``(none)``."""
    return rows.groupBy(F.coalesce(key, F.lit("(none)")).alias("grp")).agg(
        F.count("*").alias("clips"), F.count_if(accepted).alias("accepted"), (F.sum(duration) / 3600).alias("hours"), (F.coalesce(F.sum(F.when(accepted, F.col(duration))), F.lit(0.0)) / 3600).alias("accepted_hours")
    )


def grouping_sets(rows: DataFrame, keys: list[str], duration: str, rejected: Column, means: list[str]) -> DataFrame:
    """Files, rejects, hours and mean measures in all and by each key, in one pass."""
    marked = rows.withColumn("_rejected", rejected)
    grouped = marked.groupingSets([[], *[[F.col(k)] for k in keys]], *[F.col(k) for k in keys])
    return grouped.agg(F.grouping_id().cast("long").alias("gid"), F.count("*").alias("files"), F.count_if("_rejected").alias("rejected"), (F.sum(duration) / 3600).alias("hours"), *[F.avg(m).alias(f"mean_{m}") for m in means])


def stats(rows: DataFrame, value: str, group: list[str] = ()) -> DataFrame:
    """Mean, median, p10, p90 and quantiles 5, 25, 50, 75, 95 with linear interpolation."""
    p = F.percentile(value, F.array(*[F.lit(x) for x in (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)]))
    out = rows.groupBy(*group).agg(F.avg(value).alias("mean"), p.alias("p"))
    return out.select(*group, "mean", *[F.get("p", F.lit(k)).alias(n) for k, n in enumerate(("p05", "p10", "p25", "median", "p75", "p90", "p95"))])


def histogram(rows: DataFrame, value: str, width: float) -> DataFrame:
    """Counts by floor bins of a width, labelled ``lo..hi``."""
    lo = F.floor(F.col(value) / width) * width
    out = rows.where(F.col(value).isNotNull()).groupBy(lo.alias("lo")).agg(F.count("*").alias("n"))
    return out.select(F.concat(F.col("lo").cast("int"), F.lit(".."), (F.col("lo") + width).cast("int")).alias("bin"), "lo", "n").orderBy("lo")


def stat_table(rows: DataFrame, values: list[str], group: list[str] = ()) -> DataFrame:
    """Mean, least and greatest of several columns over rows that have them, one row a column."""
    long = rows.unpivot([F.col(g) for g in group] or [F.lit(0).alias("_")], values, "stat", "value")
    return long.groupBy(*group, "stat").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("lo"), F.max("value").alias("hi"))


def crosstab(rows: DataFrame, a: str, b: str, values: list[str], duration: str) -> DataFrame:
    """Hours by one key as rows and another as columns, whose values are given; missing cells are 0."""
    return rows.groupBy(a).pivot(b, values).agg(F.sum(duration) / 3600).fillna(0.0)
