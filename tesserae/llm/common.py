"""Scratch tables, Arrow batch bounds and connected components shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch handed to a Python worker. A batch holds whole texts.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Keeps the batches that Python workers receive small, as one row may be a very long text."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a temporary one only in local mode where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tesserae-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Tables of one query in the shared checkpoint folder; they go when the session ends, or on drop()."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/tesserae-{label}-{uuid.uuid4().hex[:12]}"
        self._fs(self.root, lambda fs, path: fs.deleteOnExit(path))

    def _fs(self, where: str, act):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return act(path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and returns the written rows: what follows doesn't compute df again, and survives lost executors."""
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            self._fs(f"{self.root}/{name}", lambda fs, path: fs.delete(path, True))


def components(edges: DataFrame, scratch: Scratch, rounds: int = 64) -> DataFrame:
    """(node, root) of every node of edges (u, v); root is the least node that it reaches.

    Alternating large-star and small-star rounds. Each round groups with partial minima and joins them back, so a node
    with very many links is summed before the shuffle and its join can be split. No group is collected anywhere.
    An empty edge table gives an empty result.
    """
    pairs = lambda a, b: F.struct(F.col(a).alias("u"), F.col(b).alias("v"))

    def seal(df: DataFrame, k: int) -> tuple[DataFrame, tuple]:
        df = scratch.save(df.filter("u <> v").distinct(), f"edges{k}")
        seen = df.agg(F.count("*"), F.sum(F.shiftrightunsigned(F.xxhash64("u", "v"), 20))).first()
        return df, tuple(seen)

    now, mark = seal(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), 0)
    for k in range(1, rounds):
        if not mark[0]:
            break
        both = now.select(F.explode(F.array(pairs("u", "v"), pairs("v", "u"))).alias("e")).select("e.*")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(pairs("u", "m"), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("e")).select("e.*")
        before = mark
        now, mark = seal(small, k)
        scratch.drop(f"edges{k - 1}")
        if mark == before:
            break
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
