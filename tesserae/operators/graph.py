"""The graph of chunks and numbered sections, and the expansion of retrieved chunks along it.

Nodes and edges are tables. One chunk's own order is its chunk_id within its document; all windows are per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

MAX_EXPANDED = 25


def labelled(chunks: DataFrame) -> DataFrame:
    """The chunks with the label that they carry, and the section they belong to: the last label so far, across pages."""
    so_far = Window.partitionBy("doc_id").orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, 0)
    return chunks.withColumn("label", text.section_label(F.col("text"))).withColumn("section", F.last("label", ignorenulls=True).over(so_far))


def sections(rows: DataFrame) -> DataFrame:
    """(doc_id, label, title, page, level, parent, first_chunk) of labelled rows; a section's first chunk defines it."""
    first = Window.partitionBy("doc_id", "label").orderBy("chunk_id")
    own = rows.filter("label is not null").withColumn("_k", F.row_number().over(first)).filter("_k = 1")
    return own.select(
        "doc_id", "label", text.section_title(F.col("text")).alias("title"), F.col("page_number").alias("page"),
        text.section_level(F.col("label")).alias("level"), text.parent_label(F.col("label")).alias("parent"), F.col("chunk_id").alias("first_chunk"),
    )


def nodes(chunks: DataFrame) -> DataFrame:
    """(doc_id, id, node_type, chunk_index, page, chunk_type, text_preview, label, title, level)."""
    rows = labelled(chunks)
    none = lambda kind: F.lit(None).cast(kind)
    own = rows.select(
        "doc_id", F.concat(F.lit("chunk_"), F.col("chunk_id").cast("string")).alias("id"), F.lit("chunk").alias("node_type"), F.col("chunk_id").alias("chunk_index"), F.col("page_number").alias("page"),
        "chunk_type", text.preview(F.col("text")).alias("text_preview"), none("string").alias("label"), none("string").alias("title"), none("int").alias("level"),
    )
    secs = sections(rows).select(
        "doc_id", F.concat(F.lit("sec_"), F.col("label")).alias("id"), F.lit("section").alias("node_type"), none("int").alias("chunk_index"), "page",
        none("string").alias("chunk_type"), none("string").alias("text_preview"), "label", "title", "level",
    )
    return own.unionByName(secs.withColumn("chunk_index", F.col("chunk_index").cast(own.schema["chunk_index"].dataType)))


def edges(chunks: DataFrame) -> DataFrame:
    """(doc_id, src, dst, edge_type, ord): chunk_of, subsection_of, references (ord: place in the text) and sequential."""
    rows = labelled(chunks)
    secs = sections(rows)
    chunk = lambda c: F.concat(F.lit("chunk_"), F.col(c).cast("string"))
    sec = lambda c: F.concat(F.lit("sec_"), F.col(c))
    edge = lambda df, src, dst, kind, order=None: df.select("doc_id", src.alias("src"), dst.alias("dst"), F.lit(kind).alias("edge_type"), (F.lit(0) if order is None else order).cast("int").alias("ord"))

    of = edge(rows.filter("section is not null"), chunk("chunk_id"), sec("section"), "chunk_of")
    above = secs.select("doc_id", F.col("label").alias("parent"), F.col("first_chunk").alias("_before"))
    under = edge(secs.join(above, ["doc_id", "parent"]).filter("_before < first_chunk"), sec("label"), sec("parent"), "subsection_of")
    refs = rows.select("doc_id", "chunk_id", "section", F.posexplode(text.references(F.col("text"))).alias("pos", "ref"))
    refs = refs.groupBy("doc_id", "chunk_id", "section", "ref").agg(F.min("pos").alias("pos")).filter("section is null or section <> ref")
    refers = edge(refs.join(secs.select("doc_id", F.col("label").alias("ref")), ["doc_id", "ref"]), chunk("chunk_id"), sec("ref"), "references", F.col("pos"))
    order = Window.partitionBy("doc_id").orderBy("chunk_id")
    follow = rows.select("doc_id", "chunk_id", "page_number", F.lead("chunk_id").over(order).alias("_next"), F.lead("page_number").over(order).alias("_page"))
    next_ = edge(follow.filter("_page = page_number"), chunk("chunk_id"), chunk("_next"), "sequential")
    return of.unionByName(under).unionByName(refers).unionByName(next_)


def stats(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """(kind, n): how many nodes and edges there are of each type."""
    return node_rows.groupBy(F.col("node_type").alias("kind")).agg(F.count("*").alias("n")).unionByName(edge_rows.groupBy(F.col("edge_type").alias("kind")).agg(F.count("*").alias("n")))


def seeds_by_text(seeds: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, rank, doc_id, chunk_id) of seeds (query_id, rank, doc_id, text) found by their text; the last chunk with a text counts, others go."""
    last = chunks.groupBy("doc_id", "text").agg(F.max("chunk_id").alias("chunk_id"))
    return seeds.join(last, ["doc_id", "text"]).select("query_id", "rank", "doc_id", "chunk_id")


def expand(seeds: DataFrame, edge_rows: DataFrame, most: int = MAX_EXPANDED) -> DataFrame:
    """(query_id, doc_id, chunk_id, pos): the seeds (query_id, rank, doc_id, chunk_id), then what they lead to, at most most rows a query.

    Each seed in turn leads to the chunks of its section, of the sections it refers to in the order of its text, and to
    the next chunk of its page. A chunk counts where it is first reached.
    """
    node = F.concat(F.lit("chunk_"), F.col("chunk_id").cast("string"))
    start = seeds.withColumn("src", node)
    number = lambda c: F.substring_index(F.col(c), "_", -1).cast("int")
    members = edge_rows.filter("edge_type = 'chunk_of'").select("doc_id", F.col("dst").alias("sec"), number("src").alias("found"))
    hops = start.join(edge_rows, ["doc_id", "src"])
    step = F.when(F.col("edge_type") == "chunk_of", 1).otherwise(2)
    through = hops.filter("edge_type in ('chunk_of', 'references')").withColumn("sec", F.col("dst")).join(members, ["doc_id", "sec"])
    through = through.select("query_id", "doc_id", F.col("found").alias("chunk_id"), F.struct(F.lit(1).alias("late"), "rank", step.alias("step"), "ord", F.col("found").alias("last")).alias("at"))
    direct = hops.filter("edge_type = 'sequential'").select(
        "query_id", "doc_id", number("dst").alias("chunk_id"), F.struct(F.lit(1).alias("late"), "rank", F.lit(3).alias("step"), "ord", number("dst").alias("last")).alias("at")
    )
    own = seeds.select("query_id", "doc_id", F.col("chunk_id").cast("int").alias("chunk_id"), F.struct(F.lit(0).alias("late"), "rank", F.lit(0).alias("step"), F.lit(0).alias("ord"), F.lit(0).alias("last")).alias("at"))
    best = own.unionByName(through).unionByName(direct).groupBy("query_id", "doc_id", "chunk_id").agg(F.min("at").alias("at"))
    order = Window.partitionBy("query_id").orderBy("at", "doc_id", "chunk_id")
    return best.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= most).select("query_id", "doc_id", "chunk_id", "pos")


def save(node_rows: DataFrame, edge_rows: DataFrame, path: str) -> None:
    node_rows.write.mode("overwrite").parquet(f"{path}/nodes")
    edge_rows.write.mode("overwrite").parquet(f"{path}/edges")


def load(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
