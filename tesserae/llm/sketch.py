"""Threshold-scaled document fingerprints: every shingle hash below a fixed fraction of the hash space is retained.

Built from DataFrame functions alone. A sketch is the sorted array of distinct retained hashes. As the threshold is the
same for all texts, the sketch of a union is the union of sketches, and the share of a sketch found in another estimates
containment however unequal the two texts are. A text of which no hash falls below the threshold keeps its least one, so
that only a text without words has an empty sketch; merged() drops such a stand-in once a retained hash is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Words of a shingle, and the retained fraction of the hash space as 1 / SCALE.
WIDTH, SCALE = 5, 8
#: Characters of a text that ranges may cut by.
PREFIX = 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def limit(scale: int) -> int:
    """Hashes as signed longs below this are retained."""
    return -(1 << 63) + (1 << 64) // scale


def sketch(text: Column, width: int = WIDTH, scale: int = SCALE) -> Column:
    """The sketch of a text: lower-cased A-Z, words of non-blank characters, shingles of width words (fewer: all of them)."""
    words = F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    marks = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(m: Column) -> Column:
        full = F.transform(F.sequence(F.lit(1), F.size(m) - (width - 1)), lambda i: F.xxhash64(*(F.element_at(m, i + k) for k in range(width))))
        few = F.array(F.aggregate(m, F.size(m).cast("long"), lambda h, x: F.xxhash64(h, x)))
        return F.when(F.size(m) >= width, full).when(F.size(m) > 0, few).otherwise(F.array().cast("array<bigint>"))

    def retained(h: Column) -> Column:
        low = F.array_sort(F.array_distinct(F.filter(h, lambda x: x < F.lit(limit(scale)))))
        return F.when((F.size(low) > 0) | (F.size(h) == 0), low).otherwise(F.array(F.array_min(h)))

    return _let(marks, lambda m: _let(shingles(m), retained))


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of two texts' shingles together."""
    both = F.array_sort(F.array_union(a, b))
    low = F.filter(both, lambda x: x < F.lit(limit(scale)))
    return F.when(F.size(low) > 0, low).otherwise(F.slice(both, 1, 1))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; of two empty sketches 1, of one empty sketch 0."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(a)), F.lit(0.0)))


def resemblance(a: Column, b: Column) -> Column:
    """Estimated share of all shingles of a and b that both have, 0 to 1; of two empty sketches 1."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.try_divide(both, F.size(a) + F.size(b) - both))


def as_text(a: Column) -> Column:
    """A sketch as 16 lowercase hex digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def cuts_of(keys: DataFrame, parts: int) -> list:
    """At most parts - 1 values of k that cut the rows (k) into ranges of about as many each: of a sample of 100 rows a range, drawn one by one."""
    rows = keys.count()
    found = [r["k"] for r in keys.sample(min(1.0, 100 * parts / max(rows, 1)), seed=11).sort("k").collect()]
    return list(dict.fromkeys(found[len(found) * j // parts] for j in range(1, parts) if found))


def with_next(docs: DataFrame, value: Column, name: str) -> DataFrame:
    """docs (doc_id, text) with the value of the next row by (doc_id, text); the last row gets the first row's.

    Rows are dealt out by ranges of doc_id and the first PREFIX characters of text, a range to a task, so no task sees more
    than its range, also if one id has very many texts. The first rows of each range are also dealt to the range before it,
    where they only serve as the next of its last row. The ranges are as many as the shuffle partitions; their cuts, a
    sample of ids that finds them, and the least row's id and prefix of each are all that reaches the driver.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema["doc_id"].dataType
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("doc_id"), F.left("text", F.lit(PREFIX)).alias("prefix"))
    known_as = lambda k: F.struct(F.lit(k["known"]).alias("known"), F.lit(k["doc_id"]).cast(kind).alias("doc_id"), F.lit(k["prefix"]).alias("prefix"))
    cuts = cuts_of(docs.select(key.alias("k")), parts)
    docs = docs.withColumn("_k", key)
    place = F.size(F.filter(F.array(*map(known_as, cuts)), lambda c: c <= F.col("_k"))) if cuts else F.lit(0)
    heads = sorted((r["p"], r["head"]) for r in docs.groupBy(place.alias("p")).agg(F.min("_k").alias("head")).collect())
    before = {p: heads[k - 1][0] for k, (p, _) in enumerate(heads)}
    known = spark.createDataFrame([(p, least, before[p]) for p, least in heads], StructType([StructField("_hp", IntegerType()), StructField("_least", docs.schema["_k"].dataType), StructField("_before", IntegerType())]))
    placed = docs.withColumn("_p", place).join(F.broadcast(known), F.col("_p") == F.col("_hp"), "left")
    placed = placed.withColumn("_to", F.when(F.col("_k") == F.col("_least"), F.col("_before"))).drop("_hp", "_least", "_before", "_k")
    spots = F.when(F.col("_to").isNull(), F.array(F.struct(F.col("_p").alias("p"), F.lit(False).alias("copy")))).otherwise(
        F.array(F.struct(F.col("_p").alias("p"), F.lit(False).alias("copy")), F.struct(F.col("_to").alias("p"), F.lit(True).alias("copy")))
    )
    dealt = placed.withColumn(name, value).withColumn("_at", F.explode(spots)).drop("_p", "_to").withColumn("_part", F.col("_at.p")).repartitionById(parts, F.col("_part"))
    order = Window.partitionBy("_part").orderBy("_at.copy", "doc_id", "text")
    dealt = dealt.withColumn("_next", F.lead(F.struct("text", name)).over(order)).filter("not _at.copy")
    return dealt.withColumn("_next_text", F.col("_next.text")).withColumn(f"next_{name}", F.col(f"_next.{name}")).drop("_at", "_next", "_part")


def fingerprint(docs: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """Fingerprints of every row of docs (doc_id, text, ...) and of its edited text.

    The edited text has its last floor(n / 2) code points replaced by the first as many (or all) of the next text, by
    ascending doc_id, after the last the first. near_edited and near_next are the containment of the text's sketch in the
    edited text's and in the next text's; alike_edited and alike_next the resemblance. Ids may be of any type that has an
    order; texts of any length are taken whole. A null text counts as empty; rows
    under one doc_id follow each other by text, null ids come first; the only row of a table is its own next. An empty
    table gives an empty result. Other columns are not looked at.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(docs, sketch(F.col("text"), width, scale), "sketch")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("_next_text"), F.lit(1), half)).alias("edited"), "sketch", "next_sketch"
    ).withColumn("edited_sketch", sketch(F.col("edited"), width, scale))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        containment(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("alike_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("alike_next"),
    )
