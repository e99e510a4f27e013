"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vocalith.plans.scratch import materialize


def _seal(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Every node of ``edges`` (two long columns) with ``root``, the smallest node it is connected to.

    Large-star and small-star rounds (Kiveris et al., 2014) until the edge set stands still: O(log^2) rounds, each a
    constant number of shuffles of narrow rows. Each round is written to the shared folder, and only a count and a
    checksum reach the driver. Nulls and self-links are no edges; repeated edges count once; no edges: an empty table.
    """
    ends = F.col(src).cast("long"), F.col(dst).cast("long")
    pair = edges.where(ends[0].isNotNull() & ends[1].isNotNull()).select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b"))
    now = materialize(pair.where("a < b").distinct(), "edges")
    seal = _seal(now)
    while seal[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        after = materialize(small.union(low.select(F.col("m"), F.col("b"))).distinct(), "edges", now)
        seal_after = _seal(after)
        now, done = after, seal_after == seal
        seal = seal_after
        if done:
            break
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(roots)
