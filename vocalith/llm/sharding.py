"""A reproducible shuffle: a Feistel permutation of the global row numbers, with cycle walking.

Rows are numbered 0 to n - 1, the permutation moves number i to p(i), and p(i) names the place: shard p(i) mod shards,
slot p(i) div shards. Shard sizes differ by one at most (law ``rows``), slots have no gaps, and ``place_of`` and ``row_at``
compute a place from a number, or a number from a place, without touching data.

Row numbers need a total order that no machine has to sort alone. Rows fall into buckets by a hash of all their columns,
buckets are counted (their counts are all that reaches the driver, and their number is fixed by the row count), and each row's
number is its bucket's offset plus its rank inside. Only rows that are equal in every column share a bucket by need; where
one has more than a bucket's rows, its copies are dealt over buckets of their own, and no other row moves. As equal rows are
interchangeable, every row has the same place on every run, however the table lies.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from vocalith.llm.native import unused
from vocalith.plans.scratch import materialize

ROUNDS = 6
#: Rows of a bucket, about.
BUCKET_ROWS = 50_000
#: Copies of one row that are never spread.
SPREAD = 16


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64((key * 0x9E3779B97F4A7C15) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Permutation:
    """A bijection of 0 .. n - 1 that a seed fixes; ``forward`` and ``back`` take arrays."""

    def __init__(self, n: int, seed: int):
        self.n, self.seed = n, seed
        self.half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)

    def _rounds(self, x: np.ndarray, keys) -> np.ndarray:
        a, b = x >> self.half, x & self.mask
        for k in keys:
            a, b = b, a ^ (_mix(b, self.seed * 1009 + k + 1) & self.mask)
        return (a << self.half) | b

    def _swapped(self, x: np.ndarray) -> np.ndarray:
        return ((x & self.mask) << self.half) | (x >> self.half)

    def _walk(self, x, step) -> np.ndarray:
        """Step until every number is below n again: the numbers beyond n lie between two others on one cycle."""
        out = step(np.asarray(x, np.uint64))
        while (over := np.flatnonzero(out >= self.n)).size:
            out[over] = step(out[over])
        return out

    def forward(self, x) -> np.ndarray:
        return self._walk(x, lambda v: self._rounds(v, range(ROUNDS)))

    def back(self, x) -> np.ndarray:
        return self._walk(x, lambda v: self._swapped(self._rounds(self._swapped(v), range(ROUNDS - 1, -1, -1))))


def place_of(row: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of a row number."""
    p = int(Permutation(n, seed).forward([row])[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    """Row number at a place."""
    return int(Permutation(n, seed).back([slot * shards + shard])[0])


def permuted(column: Column, n: int, seed: int) -> Column:
    if n == 0:
        return column

    @F.pandas_udf("long")
    def of(x: pd.Series) -> pd.Series:
        return pd.Series(Permutation(n, seed).forward(x.to_numpy()).astype(np.int64))

    return of(column)


def numbered(rows: DataFrame, key: list[str], out: str = "row_number") -> tuple[DataFrame, int]:
    """``rows`` with a global number 0 .. n - 1 by bucket, then the key, then a hash of all columns; and n.

    Columns of type map cannot be hashed and do not count. No rows: an empty table and 0.
    """
    found = rows.count()
    buckets = max(16, -(-found // BUCKET_ROWS))
    most = max(SPREAD, found // buckets)  # rows of a bucket, about
    digest, bucket, extra, offset, rank = (unused(x, [*rows.columns, out]) for x in ("_digest", "_bucket", "_extra", "_offset", "_rank"))
    hashed = [c for c, kind in rows.dtypes if not kind.startswith("map")]
    placed = rows.withColumn(digest, F.xxhash64(*hashed)).withColumn(bucket, F.pmod(digest, F.lit(buckets)).cast("long"))
    counts = {r[0]: r[1] for r in placed.groupBy(bucket).count().collect()}
    crowded = [b for b, n in counts.items() if n > 2 * most]
    if crowded:
        own = placed.where(F.col(bucket).isin(crowded)).groupBy(digest).count().where(F.col("count") > most)
        hot = sorted((r[0], r[1]) for r in own.collect())  # as many as buckets at most
        first, spread = buckets, []
        for d, n in hot:
            spread.append((d, first, -(-n // most)))
            first += -(-n // most)
        if spread:
            table = rows.sparkSession.createDataFrame(spread, f"{digest} long, {extra} long, {offset} long")
            dealt = F.coalesce(F.col(extra) + F.monotonically_increasing_id() % F.col(offset), F.col(bucket))
            placed = placed.join(F.broadcast(table), digest, "left").withColumn(bucket, dealt).drop(extra, offset)
            placed = materialize(placed, "numbered")  # copies are dealt once, whatever is computed again
            counts = {r[0]: r[1] for r in placed.groupBy(bucket).count().collect()}
    offsets, total = {}, 0
    for b in sorted(counts):
        offsets[b], total = total, total + counts[b]
    table = rows.sparkSession.createDataFrame([(b, o) for b, o in offsets.items()], f"{bucket} long, {offset} long")
    inside = F.row_number().over(Window.partitionBy(bucket).orderBy(*key, digest)) - 1
    ranked = placed.withColumn(rank, inside).join(F.broadcast(table), bucket)  # a row a bucket
    return ranked.withColumn(out, F.col(offset) + F.col(rank)).drop(bucket, rank, offset, digest), total


def shard(documents: DataFrame, shards: int, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``documents`` with row_number, shard and slot; all columns stay, and columns of these names are replaced.

    Null ids and texts count as values of their own; equal rows get places of their own; texts, however long, move with
    their rows. An empty table gives an empty one.
    """
    plain = documents.drop("row_number", "shard", "slot")
    tie, place = unused("_text", plain.columns), unused("_place", plain.columns)
    rows, n = numbered(plain.withColumn(tie, F.xxhash64(text_col)), [id_col, tie])
    moved = rows.withColumn(place, permuted(F.col("row_number"), n, seed)).drop(tie)
    at = F.col(place)
    return moved.withColumns({"shard": (at % shards).cast("int"), "slot": F.expr(f"`{place}` div {shards}")}).drop(place)


def query(spark, sf_dir: str) -> DataFrame:
    """All documents over 24 shards under the law of equal row counts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("long") + 8
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    narrow = documents.select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("h"))
    rows, n = numbered(materialize(narrow, "rows"), ["doc_id", "h"])
    placed = rows.withColumn("p", permuted(F.col("row_number"), n, 0))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("p") % 24).cast("int").alias("shard"),
        F.expr("p div 24").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
