"""Layout-aware chunks of page elements, with bridging overlap.

Elements (doc_id, page_number, elem_no, type, text, bbox, confidence, image_path) become chunks (doc_id, chunk_id, text,
page_number, bboxes, chunk_type, confidence, image_path). A heading or a table ends the section before it: sections are
gaps-and-islands over a page's parts. Within a section the parts are packed by a scan in order, which remembers one number;
what is gathered in a row is one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, text

MAX_CHARS, MIN_CHARS, OVERLAP = 800, 40, 0.25
# Fixed value: a numbered section that begins within a line.
INLINE = r"(?U)(?<=[.!?\s])(?:§\s*)?(\d{1,2}(?:\.\d)?)\s+([A-ZÄÖÜ][\wäöüÄÖÜ\s\-,]{3,60}?)\s+(?=[A-ZÄÖÜ\w])"
HEADING_CONFIDENCE, DEFAULT_CONFIDENCE = 0.90, 0.8


def parts(elements: DataFrame, inline: str = INLINE) -> DataFrame:
    """The elements without noise, cut at inline headings: kind is table, heading or body."""
    kept = elements.filter(~text.is_noise(F.col("text")))
    one = lambda c, heading: F.array(F.struct(c.alias("text"), F.lit(heading).alias("heading")))
    whole, inner = one(F.col("text"), False), text.inline_parts(F.col("text"), inline)
    cut = F.when(F.col("type") == "table", whole).when(text.is_heading(F.col("text")), one(F.col("text"), True)).otherwise(text.let(inner, lambda found: F.when(F.size(found) > 1, found).otherwise(one(text.strip(F.col("text")), False))))
    made = kept.select("*", F.posexplode(cut).alias("part_no", "part"))
    kind = F.when(F.col("type") == "table", "table").when(F.col("part.heading"), "heading").otherwise("body")
    return made.select("doc_id", "page_number", "image_path", "elem_no", "part_no", kind.alias("kind"), F.col("part.text").alias("text"), "bbox", "confidence")


def packed(rows: DataFrame, by: list[str], order: list[str], limit: int, size: Column) -> DataFrame:
    """Rows with group, the number of the group that each falls into among the rows of its section (by), in order.

    A group is closed before a text that would take it past limit, unless it is empty. Whether it is depends on all rows
    before it, so sections are scanned in order: rows are dealt out by section and sorted, and a scan needs no more than
    the size of the group so far. by[:2] must deal sections out; no section is gathered anywhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total, group = None, 0, 0
        for batch in batches:
            found = []
            for section, n in zip(zip(*(batch.column(c).to_pylist() for c in by), strict=True), batch.column("_size").to_pylist(), strict=True):
                if section != last:
                    last, total, group = section, 0, 0
                if total and total + n > limit:
                    total, group = 0, group + 1
                total += n
                found.append(group)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.int32())], [*batch.schema.names[:-1], "group"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", group int"
    return rows.withColumn("_size", size).repartition(*by[:2]).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def base_chunks(elements: DataFrame, limit: int = MAX_CHARS, inline: str = INLINE) -> DataFrame:
    """Chunks before overlap and filters: (doc_id, page_number, ord, text, bboxes, chunk_type, confidence, image_path)."""
    rows = parts(elements, inline)
    order = Window.partitionBy("doc_id", "page_number").orderBy("elem_no", "part_no")
    rows = rows.withColumn("island", F.sum((F.col("kind") != "body").cast("int")).over(order)).withColumn("seq", F.row_number().over(order))

    tables = rows.filter((F.col("kind") == "table") & geometry.is_valid(F.col("bbox"))).select(
        "doc_id", "page_number", "image_path", "seq", "text", F.array("bbox").alias("bboxes"), F.lit("table").alias("chunk_type"), "confidence"
    )
    headings = rows.filter("kind = 'heading'").select("doc_id", "page_number", "island", F.struct("seq", "text", "bbox", "confidence", "image_path").alias("heading"))
    section = ["doc_id", "page_number", "island"]
    bodies = packed(rows.filter("kind = 'body'").drop("elem_no", "part_no", "kind"), section, ["seq"], limit, F.length("text"))
    member = F.struct("seq", "text", "bbox", "confidence", "image_path")
    grouped = bodies.groupBy(*section, "group").agg(F.array_sort(F.collect_list(member)).alias("members"))  # limit characters, or one text
    opened = grouped.join(headings, section, "full")  # a section has one heading at most
    has = F.col("members").isNotNull()
    head = F.when(F.col("heading").isNotNull() & (~has | (F.col("group") == 0)), F.array("heading")).otherwise(F.slice("members", 1, 0))
    opened = opened.withColumn("all", F.when(has, F.concat(head, "members")).otherwise(head))
    joined, boxes = F.array_join(F.col("members.text"), " "), geometry.valid_boxes(F.col("all.bbox"))
    texts = opened.select(
        "doc_id", "page_number", F.array_max("all.image_path").alias("image_path"), F.get(F.coalesce("members", "all"), F.lit(0))["seq"].alias("seq"),
        F.when(~has, F.col("heading.text")).when(F.col("heading").isNotNull(), F.concat(F.col("heading.text"), F.lit("\n"), joined)).otherwise(joined).alias("text"),
        F.when((F.size(boxes) > 0) | ~has, boxes).otherwise(F.slice(F.col("all.bbox"), 1, 1)).alias("bboxes"),
        F.lit("text").alias("chunk_type"), F.when(~has, F.lit(HEADING_CONFIDENCE)).otherwise(F.coalesce(F.array_min("all.confidence"), F.lit(DEFAULT_CONFIDENCE))).alias("confidence"),
    )
    every = tables.unionByName(texts)
    return every.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number", "seq")) - 1).drop("seq")


def bridges(chunks: DataFrame, limit: int = MAX_CHARS, least: int = MIN_CHARS, overlap: float = OVERLAP) -> DataFrame:
    """The chunks (doc_id, ord, ...) with a bridge behind each that is followed by another, across pages; none touches a table.

    A bridge is the end of one and the beginning of the next; ord becomes 2 * ord, a bridge's 2 * ord + 1.
    """
    span = F.lit(max(40, int(limit * overlap)))
    order = Window.partitionBy("doc_id").orderBy("ord")
    rows = chunks.withColumn("_next", F.lead(F.struct("text", "bboxes", "chunk_type", "confidence")).over(order))
    tail, head = text.strip(F.right(F.col("text"), span)), text.strip(F.left(F.col("_next.text"), span))
    joined = F.concat(tail, F.lit(" "), head)
    wanted = F.col("_next").isNotNull() & (F.col("chunk_type") != "table") & (F.col("_next.chunk_type") != "table") & (tail != "") & (head != "") & (F.length(joined) >= least)
    fields = ["ord", "text", "bboxes", "chunk_type", "confidence"]
    own = F.struct((F.col("ord") * 2).alias("ord"), *fields[1:])
    bridge = F.struct(
        (F.col("ord") * 2 + 1).alias("ord"), joined.alias("text"), geometry.union_boxes(F.col("bboxes"), F.col("_next.bboxes")).alias("bboxes"),
        F.lit("overlap").alias("chunk_type"), F.least("confidence", "_next.confidence").alias("confidence"),
    )
    rest = [c for c in chunks.columns if c not in fields]
    return rows.select(*rest, F.explode(F.when(wanted, F.array(own, bridge)).otherwise(F.array(own))).alias("_c")).select(*rest, "_c.*")


def filtered(chunks: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """The chunks that are long enough, no noise, and the first of their document with their key; chunk_id numbers them."""
    kept = chunks.filter((F.length(text.strip(F.col("text"))) >= least) & ~text.is_noise(F.col("text"))).withColumn("_key", text.dedupe_key(F.col("text")))
    first = Window.partitionBy("doc_id", "_key").orderBy("ord")
    kept = kept.withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k", "_key")
    return kept.withColumn("chunk_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1).drop("ord")


def chunk(elements: DataFrame, limit: int = MAX_CHARS, least: int = MIN_CHARS, overlap: float = OVERLAP, inline: str = INLINE) -> DataFrame:
    """The chunks of the elements."""
    return filtered(bridges(base_chunks(elements, limit, inline), limit, least, overlap), least)
