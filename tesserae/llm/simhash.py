"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. Two fingerprints at two or fewer differing bits have a segment
that differs in at most one bit, and so agree in one of its 32 one-wildcard variants. Every variant is an index key;
fingerprints with a key that another one has are candidates. All candidates, whatever their number in a key, are verified
by one rule: two fingerprints link exactly if they share a 64-bit value that differs from either in at most one bit. The
at most 65 fingerprints around a value are kept as a mask, so no key is paired with itself and no group is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import resemblance
from .common import Scratch, bound_batches, components

#: Shingles summed at a time, which bounds the memory for a very long text.
BLOCK = 1 << 16


def fingerprint(text: str | None, width: int = 3) -> int:
    """The fingerprint of one text: lower-cased A-Z, words of non-blank characters, shingles of width words with repeats."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n]
    ends = ends[-n:]
    hash64, view, votes = xxhash.xxh64_intdigest, memoryview(line), np.zeros(64, np.int64)
    for k in range(0, n, BLOCK):
        h = np.array([hash64(view[a:b], 42) for a, b in zip(starts[k : k + BLOCK].tolist(), ends[k : k + BLOCK].tolist(), strict=True)], "<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, text: str = "text") -> DataFrame:
    """(doc_id, h, fp) of every row; h is a hash of the text, fp its fingerprint as a signed long. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(fps)], ["doc_id", "h", "fp"])

    bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", text_hash(F.col(text)).alias("h"), F.col(text).cast("string"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h bigint, fp bigint")


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def links(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (u, v) that connect the distinct fingerprints fp just as all links at two or fewer differing bits do."""
    part = {0: "(fp & 4294967295L)", 1: "shiftrightunsigned(fp, 32)"}
    keys = F.expr("concat(" + ", ".join(f"transform(sequence(0, 31), i -> shiftleft({32 * s}L + i, 32) | ({p} & ~shiftleft(1L, i)))" for s, p in part.items()) + ")")
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fps = fps.repartition(tasks, "fp")  # 8 bytes a row move, so that all tasks share the variants
    index = fps.select("fp", F.explode(keys).alias("key"))
    met = scratch.save(index.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "met")
    # the members of a key have its segment with the wildcard's bit either way: two rows a fingerprint find them, not 64
    ways = F.expr("transform(array(0L, shiftleft(1L, cast(shiftright(key, 32) & 31 as int))), bit -> shiftleft(shiftright(key, 37), 32) | (key & 4294967295L) | bit)")
    shared = met.select(F.explode(ways).alias("part")).distinct()
    near = fps.select("fp", F.explode(F.expr(f"array({part[0]}, shiftleft(1L, 32) | {part[1]})")).alias("part")).join(shared, "part").select("fp").distinct().repartition(tasks, "fp")
    ball = near.select(F.explode(F.expr("concat(array(struct(fp as key, 0L as mask, 1 as own)), transform(sequence(0, 63), i -> struct(fp ^ shiftleft(1L, i) as key, shiftleft(1L, i) as mask, 0 as own)))")).alias("x")).select("x.*")
    ball = ball.groupBy("key").agg(F.bit_or("mask").alias("mask"), F.max("own").alias("own")).filter("bit_count(mask) + own > 1")
    fps_of = F.expr("concat(if(own = 1, array(key), array()), transform(filter(sequence(0, 63), i -> (shiftrightunsigned(mask, i) & 1) = 1), i -> key ^ shiftleft(1L, i)))")
    met = ball.select(fps_of.alias("fps")).select(F.array_min("fps").alias("v"), F.explode("fps").alias("u"))
    return met.filter("u <> v").select("u", "v").distinct()


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs (doc_id, text, ...).

    component_id is the smallest doc_id among all documents reachable over links, the document itself included. A null or
    blank text has fingerprint zero and links like any other, a text of any length is summed in blocks; repeated rows stay and share a component; an empty table
    gives an empty result; a null doc_id gets the smallest non-null id that it reaches. Other columns are not looked at.
    """
    fps, placed = _placed(docs, width)
    heads = placed.groupBy("root").agg(F.min("least.doc_id").alias("component_id"))
    by_fp = placed.join(heads, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp", "left").select("doc_id", "fp", "component_id")


def _placed(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows, and (fp, least, root) of the distinct ones: the least row with it, and its component's root."""
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.save(fingerprints(docs, width), "fps")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("least")
    nodes = scratch.save(fps.groupBy("fp").agg(least), "nodes")
    roots = scratch.save(components(links(nodes.select("fp"), scratch), scratch), "roots")
    scratch.drop("met")
    return fps, nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def linked(made: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (u, v) of the nodes made (s, fp, ...) that are linked by their fingerprints: each with its fingerprint's least node, and those of linked fingerprints."""
    least = scratch.save(made.groupBy("fp").agg(F.min("s").alias("u")), "least")
    same = made.select(F.col("s").alias("v"), "fp").join(least, "fp").filter("u <> v").select("u", "v")
    edges = scratch.save(links(least.select("fp"), scratch), "edges")
    side = lambda name: least.select(F.col("fp").alias(f"fp_{name}"), F.col("u").alias(name))
    near = edges.select(F.col("u").alias("fp_u"), F.col("v").alias("fp_v")).join(side("u"), "fp_u").join(side("v"), "fp_v").select("u", "v")
    pairs = scratch.save(same.unionByName(near), "linked")
    scratch.drop("met", "edges", "least")
    return pairs


def keep_one(docs: DataFrame, width: int = 5) -> DataFrame:
    """docs without all but one document of each group of near copies: the one with the smallest doc_id, of its texts the one
    with the least hash, and of its repeated rows one. Texts are linked at a resemblance of their sets of shingles of 0.8,
    verified on the sets: those at two or fewer differing bits by their fingerprints, the others, as bits find only texts that
    are all but equal, by a wider signature. Documents without doc_id come last. Names of columns that begin with __tess are the operator's own.
    """
    scratch = Scratch(docs.sparkSession, "resemblance")
    made = scratch.save(resemblance.nodes(docs, width, text_hash(F.col("text")), fingerprint), "nodes")
    found = linked(made, Scratch(docs.sparkSession, "simhash"))
    roots = resemblance.roots(made, found, docs, width, text_hash(F.col("text")), scratch)
    heads = made.join(roots, "s", "left").groupBy(F.coalesce("root", "s").alias("root")).agg(F.min("least").alias("head"))
    heads = heads.select(F.col("head.doc_id").alias("__tess_doc"), F.col("head.h").alias("__tess_head"))
    rows = docs.withColumn("__tess_h", text_hash(F.col("text")))
    hit = rows.join(heads, F.col("doc_id").eqNullSafe(F.col("__tess_doc")) & (F.col("__tess_h") == F.col("__tess_head")), "left_semi")
    # only rows that are there more than once need to meet: the others' texts don't move
    twice = scratch.save(hit.groupBy(F.col("doc_id").alias("__tess_doc"), F.col("__tess_h").alias("__tess_head")).agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "twice")
    if twice.isEmpty():
        return hit.drop("__tess_h")
    again = F.col("doc_id").eqNullSafe(F.col("__tess_doc")) & (F.col("__tess_h") == F.col("__tess_head"))
    once = hit.join(twice, again, "left_anti")
    return once.unionByName(hit.join(twice, again, "left_semi").dropDuplicates(["doc_id", "__tess_h"])).drop("__tess_h")
