"""Readers of the domain's file formats, as DataFrames."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.prep import parsed_id


def split_json(spark: SparkSession, path: str) -> DataFrame:
    """(u, i) of a JSON object {user: [item, ...]} per file or per line; empty lists are skipped."""
    text = spark.read.text(path, wholetext=True)
    pairs = text.select(F.explode(F.from_json("value", "map<string,array<bigint>>")).alias("k", "items"))
    return pairs.select(parsed_id(F.col("k")).alias("u"), F.explode("items").alias("i")).filter("u is not null and i is not null")


def ragged_text(spark: SparkSession, path: str) -> DataFrame:
    """(u, i) of lines 'user item item ...'; lines of fewer than two tokens and tokens that aren't numbers are dropped."""
    tokens = spark.read.text(path).select(F.split(F.trim(F.regexp_replace("value", "\\s+", " ")), " ").alias("t")).filter(F.size("t") >= 2)
    pairs = tokens.select(F.col("t")[0].try_cast("bigint").alias("u"), F.explode(F.slice("t", F.lit(2), F.size("t") - 1)).alias("x"))
    return pairs.select("u", F.col("x").try_cast("bigint").alias("i")).filter("u is not null and i is not null")


def interactions_file(spark: SparkSession, path: str) -> DataFrame:
    """(u, i) by the file's suffix: .json or .txt."""
    if path.endswith(".json"):
        return split_json(spark, path)
    if path.endswith(".txt"):
        return ragged_text(spark, path)
    raise ValueError(f"neither JSON nor text: {path}")


def first_existing(paths: list[str]) -> str:
    """The first path that exists."""
    for p in paths:
        if os.path.exists(p):
            return p
    raise FileNotFoundError(", ".join(paths))


def train_file(root: str, dataset: str, core: int = 5) -> str:
    """The training split of a dataset: its core folder before the folder itself, JSON before text."""
    base = os.path.join(root, dataset)
    return first_existing([os.path.join(base, f"{core}-core", "train.json"), os.path.join(base, "train.json"), os.path.join(base, f"{core}-core", "train.txt"), os.path.join(base, "train.txt")])


#: The labels of a log's x_label column.
SPLITS = {0: "train", 1: "val", 2: "test"}


def labelled_log(log: DataFrame, user: str = "userID", item: str = "itemID", label: str = "x_label") -> DataFrame:
    """(u, i, split) of an interaction log whose numbers are text in any notation; rows that don't parse or have another label are skipped."""
    parsed = log.select(parsed_id(F.col(user)).alias("u"), parsed_id(F.col(item)).alias("i"), parsed_id(F.col(label)).alias("x"))
    names = F.create_map(*[F.lit(v) for k, s in SPLITS.items() for v in (k, s)])
    return parsed.filter("u is not null and i is not null and x in (0, 1, 2)").select("u", "i", names[F.col("x").cast("int")].alias("split"))


def inter_file(spark: SparkSession, path: str) -> DataFrame:
    """(u, i, split) of a tab-separated log with a header."""
    return labelled_log(spark.read.csv(path, sep="\t", header=True))


def sizes(splits: DataFrame, users_from: str = "train") -> DataFrame:
    """One row (n_users, n_items): largest ids + 1; users from training only, or from 'all' splits."""
    u = F.col("u") if users_from == "all" else F.when(F.col("split") == "train", F.col("u"))
    return splits.agg((F.max(u) + 1).alias("n_users"), (F.max("i") + 1).alias("n_items"))


def catalogue_size(splits: DataFrame, features: DataFrame) -> DataFrame:
    """One row: n_items, at least the rows of the features."""
    return sizes(splits).crossJoin(features.agg(F.count(F.lit(1)).alias("rows"))).select(F.greatest("n_items", "rows").alias("n_items"))


def transactions(edges: DataFrame) -> DataFrame:
    """(u, items): distinct items of each user, ascending."""
    return edges.groupBy("u").agg(F.array_sort(F.collect_set("i")).alias("items"))


def matrix_rows(spark: SparkSession, path: str, rows_at_once: int = 4096) -> DataFrame | None:
    """(i, v) of a two-dimensional .npy file that all executors see; None if it doesn't exist.

    Tasks read stretches of rows through a memory map, so the file is never loaded whole.
    """
    if not os.path.exists(path):
        return None
    n = np.load(path, mmap_mode="r").shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.load(path, mmap_mode="r")
        for b in batches:
            for at in b.column(0).to_pylist():
                x = np.asarray(held[at : at + rows_at_once], np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(x))), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))], names=["i", "v"])

    return spark.range(0, n, rows_at_once).mapInArrow(run, "i bigint, v array<double>")


def csv_column(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(seed, value): a named column of a CSV in file order, blank cells skipped; an unknown column is an error."""
    df = spark.read.csv(path, header=True)
    names = {c.strip().lower(): c for c in df.columns}
    if column.lower() not in names:
        raise KeyError(column)
    value = F.trim(F.col(f"`{names[column.lower()]}`"))
    return df.select(F.monotonically_increasing_id().alias("seed"), value.try_cast("double").alias("value")).filter("value is not null")
