"""The chunk and vector table: upsert by document, scans, statistics, and vectors from a model."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, text


def upserted(existing: DataFrame, new: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The rows with all of the new rows' documents replaced; vectors stay with their (doc_id, chunk_id).

    ids (doc_id): the documents that were indexed anew, so that one without rows any more loses its old ones.
    """
    return existing.join((new if ids is None else ids).select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new)


def with_units(rows: DataFrame) -> DataFrame:
    """Rows with their embedding at length one."""
    return rows.withColumn("embedding", F.transform(geometry.unit(F.col("embedding")), lambda x: x.cast("float")))


def write(rows: DataFrame, path: str, buckets: int = 64) -> None:
    """Replaces the buckets of documents that rows touch; other buckets aren't read or written.

    Rows must hold whole buckets, as bucketed(upserted(...)) of a read by bucket does.
    """
    rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def upsert(spark: SparkSession, path: str, new: DataFrame, buckets: int = 64, ids: DataFrame | None = None) -> None:
    """Replaces the documents ids, else those of new, in the table at path, within the buckets that they fall into."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")
    ids = (new if ids is None else ids).select("doc_id").distinct()
    places = [r["b"] for r in ids.select(place.alias("b")).distinct().collect()]  # buckets at most
    old = load(spark, path)
    if old is None:
        return write(new, path, buckets)
    kept = old.filter(F.col("bucket").isin(places)).drop("bucket")
    staged = f"{path}.staged-{uuid.uuid4().hex}"  # a table can't be overwritten while it is read
    try:
        upserted(kept, new, ids).write.parquet(staged)
        rows = spark.read.parquet(staged)
        write(rows, path, buckets)
        left = {r["b"] for r in rows.select(place.alias("b")).distinct().collect()}
        for b in set(places) - left:  # nothing overwrites a bucket that has no rows any more
            clear(spark, f"{path}/bucket={b}")
    finally:
        clear(spark, staged)


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, None if there is none or it has no rows any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "UNABLE_TO_INFER_SCHEMA":  # no files
            return None
        raise


def clear(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stats(chunks: DataFrame) -> DataFrame:
    """(chunks, documents, without_box, without_image)."""
    empty = ~F.exists("bboxes", geometry.is_placed)
    return chunks.agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("documents"), F.count_if(empty).alias("without_box"), F.count_if(F.coalesce("image_path", F.lit("")) == "").alias("without_image"))


def broken(vectors: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Whether the vectors (of each group) are useless: none, all of no length, or more than one and all equal to six places."""
    first = F.min_by("embedding", "vec_id").alias("_first")
    sizes = vectors.groupBy(*(by or [])).agg(first, F.count("*").alias("n"), F.max(geometry.norm(F.col("embedding"))).alias("longest"))
    met = vectors.join(sizes, by) if by else vectors.crossJoin(F.broadcast(sizes))
    apart = F.array_max(F.zip_with("embedding", "_first", lambda a, b: F.abs(a.cast("double") - b.cast("double"))))
    made = met.groupBy(*(by or [])).agg(F.max("n").alias("n"), F.max("longest").alias("longest"), F.max(apart).alias("apart"))
    bad = F.coalesce((F.col("longest") < 1e-6) | ((F.col("n") > 1) & (F.col("apart") < 1e-6)), F.lit(True))
    return made.select(*(by or []), F.coalesce("n", F.lit(0)).alias("n"), bad.alias("broken"))


def hashed_vector(passage: str, size: int = 64) -> list[float]:
    """A vector of a text's hashed tokens, at length one: a stand-in where no embedding model is at hand."""
    v = np.zeros(size)
    for token in passage.lower().split():
        h = hashlib.md5(token.encode()).digest()
        v[h[0] % size] += 1 if h[1] & 1 else -1
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


def embed(rows: DataFrame, model: str = "hashed", embedder: Callable[[list[str]], list[list[float]]] | None = None, fallback: Callable[[list[str]], list[list[float]]] | None = None, kind: str = "passage") -> DataFrame:
    """Rows (..., text) with embedding, by a model that takes lists of texts; the model's own prefix is put before them.

    A batch on which the model fails, or that it gives useless vectors for, goes to the fallback, as do all later batches
    of the task: one task doesn't mix two models' vectors after a failure.
    """
    own = embedder or (lambda texts: [hashed_vector(t) for t in texts])
    other = fallback or (lambda texts: [hashed_vector(t) for t in texts])

    def useless(texts, vectors) -> bool:
        if not len(vectors):
            return True
        v = np.array(vectors, np.float64)
        return bool(np.all(np.linalg.norm(v, axis=1) < 1e-6) or len(set(texts)) > 1 and np.all(np.abs(v - v[0]) < 1e-6))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        failed = False
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            vectors = None
            if not failed:
                try:
                    vectors = own(texts)
                    failed = bool(texts) and useless(texts, vectors)
                except Exception:
                    failed = True
            if failed:
                vectors = other(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([[float(x) for x in v] for v in vectors], pa.list_(pa.float32()))], [*batch.schema.names[:-1], "embedding"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", embedding array<float>"
    return rows.withColumn("_prefixed", text.prefixed(F.col("text"), model, kind)).mapInArrow(run, schema)
