"""What the operators share: table access, shared storage, numbering and connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# ASCII white space of the contracts: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the warehouse folder, read by Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests) gets a folder of its own; any
    other session is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="barloom-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` hinted for a broadcast if its counted rows are at most ``most``; otherwise as it is, for a shuffled join.

    Without the hint a join with a handful of rows may shuffle the large side
    before Spark learns how small the other is.
    """
    return F.broadcast(df) if df.count() <= most else df


def unused(name: str, df: DataFrame) -> str:
    """``name`` with as many underscores in front as make it a column that ``df`` does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def fold(key: str, folds: int) -> Column:
    """Fold of a row: crc32 of the id as text."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds))


def numbered(df: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """Number the rows from 0 in the given order (nulls last) without a single-task sort.

    Rows are range-partitioned; counts per partition give each its offset. Rows
    that tie on every column get consecutive numbers in an unspecified order.
    """
    keys = [F.col(c).asc_nulls_last() for c in order]
    ranged = stored(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # one row per partition
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy("_part").orderBy(*keys)
    return (
        ranged.withColumn("_at", F.row_number().over(inside) - 1)
        .join(starts, "_part")
        .withColumn(name, F.col("_start") + F.col("_at"))
        .select(*df.columns, name)
    )


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the classes of ``a[i]`` and ``b[i]``; a label is the smallest index of its class."""
    while True:
        x, y = labels[a], labels[b]
        differ = x != y
        if not differ.any():
            return labels
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        root = np.arange(len(labels))
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            deeper = root[root]
            if np.array_equal(deeper, root):
                break
            root = deeper
        labels = root[labels]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b): the smallest node that can be reached.

    Alternating large-star and small-star steps; each round is written to the
    shared folder, so a lost executor costs one round. Only a checksum per round
    reaches the driver.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    pairs = stored(pairs.where("u != v").distinct())
    seen = None
    while True:
        mark = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark["n"] == 0 or mark == seen:
            break
        seen = mark
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("root"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("root").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("root"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("root").alias("v")), F.struct("u", F.col("root").alias("v")))).alias("p")).select("p.u", "p.v")
        pairs = stored(small.where("u != v").distinct())
    heads = pairs.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(heads)
