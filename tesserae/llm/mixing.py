"""Mixing sources to target weights by Poisson replication.

Each document's count is the inverse Poisson distribution, with its source's mean rate, at a hash of the document and a
seed. The document is repeated that often, and all copies are shuffled globally by a hash of document, copy and seed.
Counts need no state, so any executor gets the same ones again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Mean of one draw at most; a greater rate is the sum of several draws, so that no step underflows.
ONE_DRAW = 64.0
#: Texts that stand in several rows go to all tasks up to so many; beyond it they are joined.
MOST_SENT = 100_000


def uniform(*parts: Column) -> Column:
    """A number from 0 to 1 (excluded) from the MD5 of the parts, joined by colons; 52 bits."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def steps(rate: float) -> list[float]:
    """The Poisson distribution function at 0, 1, 2, ... as far as doubles can tell it from 1."""
    term = total = math.exp(-rate)
    found, k = [], 0
    while total < 1.0 and (term > 1e-18 or k < rate):
        found.append(total)
        k += 1
        term = term * rate / k
        total = total + term
    return found


def rates(docs: DataFrame, weights: dict[str, float], other: float, total: float | None, measure: Column) -> list[tuple[str | None, float]]:
    """(source, mean copies) of each weighted source, and of all other sources together under None.

    A source's rate is its share of the weights times total over its size by the measure; total is the size of all of
    docs where it is not given. A source without any size can't be brought to a weight: its rows have rate 1. A source
    without rows has none. What reaches the driver is as long as the weights.
    """
    named = F.when(F.col("source").isin(*weights), F.col("source")) if weights else F.lit(None).cast("string")
    sizes = {r["bucket"]: float(r["size"] or 0) for r in docs.groupBy(named.alias("bucket")).agg(F.sum(measure).alias("size")).collect()}
    share = {**weights, None: other}
    mass, total = sum(w for s, w in share.items() if sizes.get(s)), sum(sizes.values()) if total is None else total
    return [(s, (w / mass * total / sizes[s] if mass else 0.0) if sizes[s] else 1.0) for s, w in share.items() if s in sizes]


def mix(docs: DataFrame, weights: dict[str, float], other: float, seed: int = 17, total: float | None = None, measure: Column | None = None, most_sent: int = MOST_SENT) -> DataFrame:
    """docs with copy (from 0) and mix_key, each row repeated by its Poisson count, in the order of mix_key.

    weights: of the named sources; other: of all other sources together, null included. The rows of one source share its
    rate, also those of a null or blank text, which add nothing to its size. A draw hangs on doc_id and text, so rows
    without an id draw by their texts. Rows that are equal in all columns draw one by one; their copies are numbered
    together. Rows of one id and text that differ elsewhere share their draw; in order, ties of mix_key go by id, copy and
    text. Size is measured in code points of text unless measure says otherwise. Texts of any length are read once where
    they lie. An empty table gives an empty result. Columns that are called copy or mix_key are replaced, all others kept;
    names that begin with __tess are the operator's own. Rows move once: the copies, to the part of the order they fall
    into, as mix_key is spread evenly.
    """
    spark = docs.sparkSession
    measure = F.coalesce(F.length("text"), F.lit(0)) if measure is None else measure
    found = [(s, r, max(1, math.ceil(r / ONE_DRAW))) for s, r in rates(docs, weights, other, total, measure)]
    table = spark.createDataFrame([(s, steps(r / n), n) for s, r, n in found if r > 0], "__tess_bucket string, __tess_steps array<double>, __tess_draws int")
    named = F.when(F.col("source").isin(*weights), F.col("source")) if weights else F.lit(None).cast("string")
    met = _counted(docs.drop("copy", "mix_key").withColumn("__tess_md5", F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))), most_sent).withColumn("__tess_named", named)
    met = met.join(F.broadcast(table), F.col("__tess_named").eqNullSafe(F.col("__tess_bucket")))  # a row for each weight
    own = (F.col("doc_id"), F.col("__tess_md5"))
    one = lambda t: F.size(F.filter("__tess_steps", lambda p: p <= uniform(F.lit(seed), *own, t)))
    count = F.aggregate(F.sequence(F.lit(0), F.col("__tess_times") * F.col("__tess_draws") - 1), F.lit(0), lambda s, t: s + one(t))
    spread = met.withColumn("__tess_n", count).filter("__tess_n > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("__tess_n") - 1)))
    spread = spread.withColumn("mix_key", uniform(F.lit(seed + 1), *own, F.col("copy"))).drop("__tess_bucket", "__tess_steps", "__tess_named", "__tess_n", "__tess_draws", "__tess_times")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = spread.repartitionById(parts, F.floor(F.col("mix_key") * parts).cast("int"))
    return dealt.sortWithinPartitions("mix_key", "doc_id", "copy", "__tess_md5").drop("__tess_md5")


def _counted(docs: DataFrame, most_sent: int) -> DataFrame:
    """docs with __tess_times: rows that are equal in all columns are one row with their number. Only texts that stand in several rows are grouped, each task's own first."""
    ids = docs.groupBy("doc_id", "__tess_md5").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("__tess_id"), F.col("__tess_md5").alias("__tess_text"))
    head = ids.limit(most_sent + 1).count()
    if not head:
        return docs.withColumn("__tess_times", F.lit(1))
    ids = F.broadcast(ids) if head <= most_sent else ids
    same = docs["doc_id"].eqNullSafe(F.col("__tess_id")) & (docs["__tess_md5"] == F.col("__tess_text"))
    equal = docs.join(ids, same, "left_semi").groupBy(*docs.columns).agg(F.count("*").cast("int").alias("__tess_times"))
    return docs.join(ids, same, "left_anti").withColumn("__tess_times", F.lit(1)).unionByName(equal)
