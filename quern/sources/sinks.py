"""Writers and caches: splits, graphs with a content fingerprint, result tables."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_splits(split: DataFrame, path: str, mode: str = "overwrite") -> None:
    """(u, items) lists as JSON, one folder per split."""
    lists = split.groupBy("split", "u").agg(F.array_sort(F.collect_list("i")).alias("items"))
    lists.write.mode(mode).partitionBy("split").json(path)


def fingerprint(df: DataFrame) -> str:
    """A hash of the rows, whatever their order: their number, and sums of two row hashes."""
    h = df.select(F.xxhash64(*df.columns).alias("a"), F.hash(*df.columns).cast("bigint").alias("b"))
    r = h.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("a").cast("decimal(38,0)")).alias("a"), F.sum("b").alias("b")).first()
    return hashlib.sha1(f"{sorted(df.columns)}|{r.n}|{r.a}|{r.b}".encode()).hexdigest()


def signature(mode: str, beta: float, n_items: int, total: int) -> str:
    return hashlib.sha1(f"{mode}|{beta}|{n_items}|{total}".encode()).hexdigest()


def cache_name(mode: str, beta: float) -> str:
    """File name of a cached prior; 1.0 becomes 1p0."""
    return f"log_q_{mode}_b{str(float(beta)).replace('.', 'p').replace('-', 'm')}"


def _manifest(spark: SparkSession, path: str) -> dict | None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    p = hadoop.Path(f"{path}/manifest")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    first = spark.read.text(f"{path}/manifest").first()
    return json.loads(first.value) if first else None


def cached(path: str, build, key: str, spark: SparkSession, force: bool = False) -> DataFrame:
    """The table at ``path`` if its manifest has ``key``; else build() is written there, with a manifest, and read back."""
    m = None if force else _manifest(spark, path)
    if not m or m.get("key") != key:
        build().write.mode("overwrite").parquet(f"{path}/data")
        spark.createDataFrame([(json.dumps({"key": key}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return spark.read.parquet(f"{path}/data")


def write_interest_cache(path: str, co: DataFrame, tree: DataFrame | None, settings: dict) -> None:
    """Co-occurrence edges, the flat tree, and one row of settings."""
    spark = co.sparkSession
    co.write.mode("overwrite").parquet(f"{path}/cooc")
    if tree is not None:
        tree.write.mode("overwrite").parquet(f"{path}/tree")
    spark.createDataFrame([(json.dumps(settings, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def read_interest_cache(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    return spark.read.parquet(f"{path}/cooc"), spark.read.parquet(f"{path}/tree"), json.loads(spark.read.text(f"{path}/meta").first().value)


def append_results(runs: DataFrame, path: str) -> None:
    """Adds run records to a result table."""
    runs.write.mode("append").json(path)


def table_md5(df: DataFrame) -> str:
    """MD5 of the rows as sorted JSON hashes: equal for equal tables in any order."""
    per = df.select(F.md5(F.to_json(F.struct(*sorted(df.columns)))).alias("h")).groupBy(F.substring("h", 1, 3).alias("p")).agg(F.md5(F.concat_ws("", F.array_sort(F.collect_list("h")))).alias("h"))
    return hashlib.md5("".join(r.h for r in per.orderBy("p").toLocalIterator()).encode()).hexdigest()
