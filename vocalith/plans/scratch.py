"""Intermediate tables, written once to the folder that driver and executors share.

Spark recomputes a lost partition from its lineage. Iterative jobs cut that lineage by writing a table below
``spark.checkpoint.dir`` and reading it back, so a lost executor costs one task, not the whole history. The setting is
read from the session; only where it is unset (tests on one machine) a temporary folder is taken.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_written: dict[str, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """A URI below which every executor can read and write."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _local:
        _local["dir"] = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
    return _local["dir"]


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/vocalith-{tag}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _written.pop(path, None)


#: Spark's setting that removes the shuffle files of a write when it ends, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows in a file of a lean table: adaptive shuffles make few files, which few tasks would read.
ROWS_A_FILE = 50_000


def materialize(df: DataFrame, tag: str, replaces: DataFrame | None = None, lean: bool = False) -> DataFrame:
    """Write ``df`` and return it as read back; ``replaces`` is an earlier table that is not needed any more.

    ``lean`` spares disk, for tables that are large beside the input: the write's shuffle files go as it ends, and columns are packed closer.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    if lean:
        before = spark.conf.get(CLEANUP, "false")
        spark.conf.set(CLEANUP, "true")
        try:
            df.select("*").write.options(compression="zstd", maxRecordsPerFile=ROWS_A_FILE).parquet(path)
        finally:
            spark.conf.set(CLEANUP, before)
    else:
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    drop(replaces)
    return out


def drop(table: DataFrame | None) -> None:
    """Remove a table of ``materialize`` that is not needed any more; any other is left."""
    if table is not None and getattr(table, "scratch_path", None):
        drop_path(table.sparkSession, table.scratch_path)


@atexit.register
def _tidy() -> None:
    """Remove what a session that is still up has written; a killed driver leaves it to the folder's owner."""
    for path, spark in list(_written.items()):
        try:
            if spark.sparkContext._jsc is not None:
                drop_path(spark, path)
        except Exception:  # the session has gone already
            return
