"""Elements, labelled chunks and queries made from the driver's tables, by one formula in DataFrames and in SQL.

A document's lines are its elements: line i is element i on page 1 + i / 10, in a box of its own, a table with two pipes
or more. Sections are injected: line i with i % 7 = 0 becomes a heading, one with i % 5 = 3 refers to a section.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts that come in fewer files than half the cores (small ones of one row group) are dealt out."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name in ("documents", "pages") and len(rows.inputFiles()) < cores // 2 else rows


def folder(spark: SparkSession) -> str:
    """A new folder that all executors share; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tesserae-")
    return f"{root.rstrip('/')}/tesserae-{uuid.uuid4().hex[:12]}"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element rows of documents."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("elem_no", "text"))
    i = F.col("elem_no") % 10
    return rows.select(
        "doc_id", "elem_no", (1 + F.floor(F.col("elem_no") / 10)).cast("int").alias("page_number"),
        F.when(F.length("text") - F.length(F.replace("text", F.lit("|"), F.lit(""))) >= 2, "table").otherwise("text").alias("type"), "text",
        F.array(F.lit(72.0), 72.0 + 14.0 * i, F.lit(523.0), 84.0 + 14.0 * i).alias("bbox"),
        (F.lit(0.8) + 0.02 * (F.col("elem_no") % 7)).alias("confidence"), F.lit("").alias("image_path"),
    )


LINES = """lines AS (
  SELECT doc_id, CAST(pos - 1 AS INTEGER) AS elem_no, CAST(1 + (pos - 1) // 10 AS INTEGER) AS page_number,
    CASE WHEN length(text) - length(replace(text, '|', '')) >= 2 THEN 'table' ELSE 'text' END AS type, text,
    [72.0::DOUBLE, 72.0::DOUBLE + 14.0::DOUBLE * ((pos - 1) % 10), 523.0::DOUBLE, 84.0::DOUBLE + 14.0::DOUBLE * ((pos - 1) % 10)] AS bbox,
    0.8::DOUBLE + 0.02::DOUBLE * ((pos - 1) % 7) AS confidence
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents))"""


def sectioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk rows: each line a chunk, with injected headings and references."""
    i = F.col("elem_no")
    shown = F.when(i % 7 == 0, F.concat(F.lit("§"), F.floor(1 + i / 7).cast("string"), F.when(i % 21 == 14, F.lit(".2")).otherwise(F.lit("")), F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    shown = F.when(i % 5 == 3, F.concat(shown, F.lit(" gemäß §"), (1 + i % 4).cast("string"))).otherwise(shown)
    return lines(spark, sf_dir).select("doc_id", i.alias("chunk_id"), shown.alias("text"), "page_number", F.array("bbox").alias("bboxes"), F.col("type").alias("chunk_type"), "confidence", "image_path")


SECTIONED = (
    LINES
    + """, headed AS (
  SELECT *, CASE WHEN elem_no % 7 = 0 THEN '§' || CAST(1 + elem_no // 7 AS VARCHAR) || CASE WHEN elem_no % 21 = 14 THEN '.2' ELSE '' END || ' ' || text ELSE text END AS t FROM lines),
chunks AS (
  SELECT doc_id, elem_no AS chunk_id, CASE WHEN elem_no % 5 = 3 THEN t || ' gemäß §' || CAST(1 + elem_no % 4 AS VARCHAR) ELSE t END AS text, page_number, type AS chunk_type FROM headed),
labelled AS (
  SELECT *, coalesce(nullif(regexp_extract(text, '(?m)^(?:§\\s*(\\d+(?:\\.\\d+)*)|(\\d+(?:\\.\\d+)+))\\.?\\s+\\S', 1), ''),
    nullif(regexp_extract(text, '(?m)^(?:§\\s*(\\d+(?:\\.\\d+)*)|(\\d+(?:\\.\\d+)+))\\.?\\s+\\S', 2), '')) AS label FROM chunks),
placed AS (SELECT *, last_value(label IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY chunk_id ROWS UNBOUNDED PRECEDING) AS section FROM labelled),
sections AS (
  SELECT doc_id, label, substr(string_split(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10))[1], 1, 120) AS title, page_number AS page,
    CAST(len(string_split(label, '.')) AS INTEGER) AS level, CASE WHEN contains(label, '.') THEN regexp_replace(label, '\\.[^.]+$', '') END AS parent, chunk_id AS first_chunk
  FROM placed WHERE label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, label ORDER BY chunk_id) = 1)"""
)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query): the benchmark items."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query): the vectors whose id 50 divides as a batch of queries."""
    return table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
