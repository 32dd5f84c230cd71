"""Session-level helpers: reading tables, cutting lineage, checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its counted rows times its row width stay under this.
BROADCAST_BYTES = 32 << 20

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_dir: dict[str, str] = {}


def settled(spark: SparkSession) -> SparkSession:
    """Turns off a planner rule that gives wrong results.

    With spark.sql.unionOutputPartitioning a union of equally partitioned
    children counts as partitioned like them even after adaptive execution has coalesced
    the children differently; a later aggregation then skips its shuffle and returns a key several times.
    """
    if spark.conf.get("spark.sql.unionOutputPartitioning", "false") != "false":
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def union_all(first: DataFrame, *more: DataFrame) -> DataFrame:
    """All rows of all tables, columns by name."""
    settled(first.sparkSession)
    for df in more:
        first = first.unionByName(df)
    return first


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return settled(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where it is unset and all executors are in this process (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not _one_process(spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        holder = tempfile.TemporaryDirectory(prefix="quern-")
        atexit.register(holder.cleanup)
        _own_dir[app] = holder.name
    return "file://" + _own_dir[app]


def _one_process(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def staged(df: DataFrame, by: str | None = None, done: Iterable[DataFrame] = ()) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder, in one folder per value of ``by`` if given, and reads it back.

    This cuts the lineage like checkpoint() does, survives the loss of any
    executor, computes the plan once, and keeps column pruning. The shuffle files of the plan are
    removed once it is written, and so are the folders of ``done``: staged tables that nothing reads any more.
    What is left goes when the application ends.
    """
    spark = settled(df.sparkSession)
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    schema = df.schema
    writer = df.write if by is None else df.write.partitionBy(by)
    before = spark.conf.get(_CLEANUP, None)
    try:
        if before is not None:
            spark.conf.set(_CLEANUP, "true")
        writer.parquet(path)
    finally:
        if before is not None:
            spark.conf.set(_CLEANUP, before)
    _file_system(spark, path).deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(path))
    out = spark.read.schema(schema).parquet(path)
    out.stage_folder = path
    for table_ in done:
        dropped(table_)
    return out


def dropped(df: DataFrame) -> None:
    """Removes the folder of a table that staged() returned; frames derived from it can't be read any more."""
    path = getattr(df, "__dict__", {}).get("stage_folder")
    if path:
        spark = df.sparkSession
        _file_system(spark, path).delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)


def _file_system(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def small(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if ``rows`` counted rows of ``row_bytes`` fit in ``limit``; else as it is."""
    return F.broadcast(df) if rows * row_bytes <= limit else df
