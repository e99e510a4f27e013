"""How a plan module lists its queries, and the fixed projections of the synthetic tables that stand in for clips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Book:
    """Queries of a module by name, each with its SQL where there is one."""

    def __init__(self):
        self.queries, self.oracles = {}, {}

    def add(self, name: str, sql: str | None = None):
        def keep(f):
            self.queries[name] = f
            if sql:
                self.oracles[name] = sql
            return f

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Clip measures as projections of lineitem, in SQL that Spark and DuckDB read alike.
CLIP = {
    "id": "l_orderkey * 10 + l_linenumber",
    "speaker": "l_returnflag",
    "style": "l_linestatus",
    "duration_s": "l_quantity * 0.33e0",
    "rms_dbfs": "-6e0 - l_discount * 420e0",
    "lufs": "-8e0 - l_tax * 520e0",
    "clip_frac": "case when l_partkey % 97 = 0 then 0.02e0 else 0e0 end",
    "clip_run": "l_partkey % 7",
    "snr_db": "10e0 + l_suppkey % 40",
    "silence_ratio": "l_discount * 7e0",
    "speech_s": "l_quantity * 0.33e0 * (1e0 - l_discount * 7e0)",
    "n_chars": "case when l_linenumber = 7 then null when l_linenumber = 6 then 0 else cast(floor(l_extendedprice / 600e0) as int) end",
}


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{sql} as {name}" for name, sql in CLIP.items()])


CLIP_SQL = "select " + ", ".join(f"{sql} as {name}" for name, sql in CLIP.items()) + " from lineitem"
