"""Vector search, BM25 with page decay, the hybrid funnel, reranking, and what is built on retrieved rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Candidates for each wanted result, hits examined for each wanted result before a filter, and results by default.
MULTIPLIER, WINDOW, TOP_K = 4, 10, 15
RERANK_CHARS = 512
#: Rows of a batch's own tables that are sent to all tasks, and queries of one block.
MOST_SENT, BLOCK = 100_000, 2_048
# What stands for nothing found.
NO_RESULTS, NO_TABLE, NO_SECTION, NO_REGION = "Keine relevanten Abschnitte gefunden.", "No table found.", "Section not found.", "No region found on page."


def fits(df: DataFrame, most: int = MOST_SENT) -> bool:
    """Whether df has no more than most rows, so that it may be sent to all tasks."""
    return df.limit(most + 1).count() <= most


def bounded(df: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """df, marked to be sent to all tasks if it fits; else it is joined as any table."""
    return F.broadcast(df) if fits(df, most) else df


def _blocks(queries: DataFrame, size: int) -> Iterator[pa.Table]:
    """The queries in blocks of about size rows, one after the other."""
    parts = -(-queries.count() // size)
    for k in range(parts):
        block = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == k).toArrow()
        if block.num_rows:
            yield block


def vector_hits(vectors: DataFrame, queries: DataFrame, k: int, where: Column | None = None, post: Column | None = None, key: str = "vec_id", block: int = BLOCK) -> DataFrame:
    """(query_id, key, score, rank): for each query (query_id, query) the k vectors of greatest cosine, ties by key.

    where is applied to the vectors first and reaches the scan. post is applied to each query's first WINDOW * k hits only,
    so fewer than k rows may remain. The queries go out in blocks of a bounded size; each task multiplies its vectors, a
    batch at a time, with a block as matrices and keeps its own best rows of each query. Only those are shuffled. Scores
    are rounded to 12 places, so that the order in which a product was summed decides nothing.
    """
    found = vectors if where is None else vectors.filter(where)
    rest = [c for c in vectors.columns if c not in (key, "embedding")]
    most = k if post is None else k * WINDOW
    id_type = queries.schema["query_id"].dataType.simpleString()
    fields = [vectors.schema[c] for c in (key, *rest)]
    schema = f"query_id {id_type}, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double"
    rows = found.select(key, "embedding", *rest)
    parts = [rows.mapInArrow(_best(table, most, key, rest), schema) for table in _blocks(queries.select("query_id", "query"), block)]
    scored = reduce(DataFrame.unionByName, parts) if parts else vectors.sparkSession.createDataFrame([], schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    hits = scored.select("query_id", key, "score", *rest, F.row_number().over(order).alias("rank")).filter(F.col("rank") <= most)
    if post is not None:
        hits = hits.withColumn("_keep", post).filter("_keep").drop("_keep").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return hits


def _best(block: pa.Table, most: int, key: str, rest: list[str]) -> Callable:
    """A task's function: of its vectors the best for each query of the block."""
    unit = _units(block.column("query").to_pylist())
    ids = block.column("query_id").combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            scores = np.round(unit @ _units(batch.column(1).to_pylist(), unit.shape[1]).T, 12)  # query by vector
            at = np.arange(scores.size) if batch.num_rows <= most else np.flatnonzero(scores >= np.partition(scores, -most, axis=1)[:, -most][:, None])
            query, place = at // batch.num_rows, pa.array(at % batch.num_rows)
            made = pa.table([pa.array(query), *(batch.column(c).take(place) for c in (key, *rest)), pa.array(scores.ravel()[at])], ["query", key, *rest, "score"])
            held = made if held is None else pa.concat_tables([held, made])
            if held.num_rows > 4 * most * len(ids) + 4096:
                held = _kept(held, most, key)
        if held is not None:
            held = _kept(held, most, key)
            yield from pa.table([ids.take(held.column("query").combine_chunks()), *(held.column(c) for c in (key, *rest, "score"))], ["query_id", key, *rest, "score"]).combine_chunks().to_batches()

    return run


def _kept(rows: pa.Table, most: int, key: str) -> pa.Table:
    """Of each query's rows the best, ties by key."""
    rows = rows.sort_by([("query", "ascending"), ("score", "descending"), (key, "ascending")])
    query = rows.column("query").to_numpy()
    first = np.searchsorted(query, query)
    return rows.filter(pa.array(np.arange(len(query)) - first < most))


def _units(vectors: list, size: int | None = None) -> np.ndarray:
    """Vectors as rows of length one; those of no length, null ones and ones of another size stay zero."""
    size = max((len(v) for v in vectors if v), default=1) if size is None else size
    made = np.array([v if v and len(v) == size and None not in v else [0.0] * size for v in vectors], np.float64).reshape(len(vectors), size)
    n = np.sqrt((made * made).sum(axis=1, keepdims=True))
    return np.divide(made, n, out=np.zeros_like(made), where=n > 0)


@dataclass
class Postings:
    """What BM25 needs of a set of texts: made once, when they are indexed."""

    terms: DataFrame  # the group's columns, key, term, tf, len
    idf: DataFrame  # the group's columns, term, n, avg, idf


def postings(candidates: DataFrame, key: str = "doc_id", group: tuple[str, ...] = ()) -> Postings:
    """The postings of texts (group, key, text): every text is tokenised once for the terms and once for the statistics.

    Statistics come from one pass over the distinct terms of each text, with the lengths counted under an empty term, and
    are summed in each task before they are shuffled. A term in more than half of a set gets a share of its mean.
    """
    by = list(group)
    lists = candidates.select(*by, key, text.tokens(F.col("text")).alias("_tokens"))
    marks = F.concat(F.array(F.lit("")), F.array_distinct("_tokens"))
    df = lists.select(*by, F.size("_tokens").alias("len"), F.explode(marks).alias("term")).groupBy(*by, "term").agg(F.count("*").alias("_df"), F.sum(F.when(F.col("term") == "", F.col("len"))).alias("_len"))
    sizes = df.filter("term = ''").select(*by, F.col("_df").alias("n"), (F.col("_len") / F.col("_df")).alias("avg"))
    raw = F.ln(F.col("n") - F.col("_df") + F.lit(0.5)) - F.ln(F.col("_df") + F.lit(0.5))
    met = df.filter("term <> ''")
    met = (met.join(sizes, by) if by else met.crossJoin(F.broadcast(sizes))).withColumn("_idf", raw)  # without a group sizes is one row
    mean = met.groupBy(*by).agg(F.avg("_idf").alias("_mean"))
    met = met.join(mean, by) if by else met.crossJoin(F.broadcast(mean))
    idf = met.select(*by, "term", "n", "avg", F.when(F.col("_idf") < 0, F.lit(EPSILON) * F.col("_mean")).otherwise(F.col("_idf")).alias("idf"))
    terms = lists.select(*by, key, F.size("_tokens").alias("len"), F.explode("_tokens").alias("term")).groupBy(*by, key, "len", "term").agg(F.count("*").alias("tf"))
    return Postings(terms, idf)


def write_postings(made: Postings, path: str, parts: int = 64) -> None:
    """Writes postings into folders by their term, so that a batch of queries reads the folders of its terms alone."""
    place = F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int")
    for name, df in (("terms", made.terms), ("idf", made.idf)):
        df.withColumn("part", place).write.mode("overwrite").partitionBy("part").parquet(f"{path}/{name}")


def read_postings(spark: SparkSession, path: str) -> Postings:
    return Postings(*(spark.read.parquet(f"{path}/{name}") for name in ("terms", "idf")))


def bm25_asked(made: Postings, queries: DataFrame, key: str = "doc_id", group: tuple[str, ...] = (), parts: int = 64) -> DataFrame:
    """(query_id, key, score): Okapi BM25 for the queries (query_id, query). Repeated terms count again; rows without a term of the query aren't returned."""
    wanted = queries.select("query_id", F.explode(text.tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("_times"))
    on = [*group, "term"]
    terms, idf = made.terms, made.idf
    if "part" in terms.columns:  # written ones: the folders are known before anything is read
        places = [r["p"] for r in wanted.select(F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int").alias("p")).distinct().collect()]  # parts at most
        terms, idf = (df.filter(F.col("part").isin(places)).drop("part") for df in (terms, idf))
    small = F.broadcast if fits(wanted) else lambda df: df  # a term asked for has one row of statistics
    asked = small(idf.join(small(wanted), on).select("query_id", "term", "_times", "avg", "idf"))
    length = F.lit(1 - B) + F.lit(B) * F.col("len") / F.col("avg")
    part = F.col("_times") * F.col("idf") * F.col("tf") * F.lit(K1 + 1) / (F.col("tf") + F.lit(K1) * length)
    return terms.join(asked, on).groupBy("query_id", key).agg(F.sum(part).alias("score"))


def bm25_scores(candidates: DataFrame, queries: DataFrame, key: str = "doc_id", per_query: bool = False) -> DataFrame:
    """(query_id, key, score): Okapi BM25 of the candidates (key, text, ...) for the queries (query_id, query).

    per_query: candidates carry a query_id and are a set for each query, over which all statistics are taken; else they
    are one set for all queries. Only the terms that were asked for are counted by text: words are filtered where they are
    read, before anything is shuffled. For many batches over one set write its postings once.
    """
    group = ("query_id",) if per_query else ()
    made = postings(candidates, key, group)
    wanted = queries.select(*group, F.explode(F.array_distinct(text.tokens(F.col("query")))).alias("term")).distinct()
    lists = candidates.select(*group, key, text.tokens(F.col("text")).alias("_tokens")).select(*group, key, F.size("_tokens").alias("len"), F.explode("_tokens").alias("term"))
    terms = lists.join(bounded(wanted), [*group, "term"], "left_semi").groupBy(*group, key, "len", "term").agg(F.count("*").alias("tf"))
    return bm25_asked(Postings(terms, made.idf), queries, key, group)


def best(scored: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """The k rows of greatest score for each query, with rank; ties by key. Scores are rounded to 9 places."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), key)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def decayed(scored: DataFrame, k: int, key: str = "doc_id", page: str = "page_number", prior: str | None = None) -> DataFrame:
    """(query_id, key, final, rank): scores over their query's best, 0.9 of that and 0.1 of the page's boost, best k.

    With no score above 0 a query's rows keep their prior order. Ties go to the prior rank, then to the key; scores are
    rounded to 12 places, so that the order in which a sum was taken decides nothing.
    """
    own = Window.partitionBy("query_id")
    best = F.max("score").over(own)
    final = F.when(best > 0, F.lit(0.9) * F.coalesce(F.try_divide(F.col("score"), best), F.lit(0.0)) + F.lit(0.1) * text.page_boost(F.col(page))).otherwise(F.lit(0.0))
    last = [F.col(prior)] if prior else []
    rows = scored.withColumn("final", F.round(final, 12))
    order = own.orderBy(F.desc("final"), *last, F.col(key))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hybrid(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = TOP_K, key: str = "doc_id", where: Column | None = None, post: Column | None = None) -> DataFrame:
    """The funnel for a batch of queries (query_id, query, vector): MULTIPLIER * k nearest vectors, then BM25 with page decay, best k (TOP_K for 0).

    Statistics are those of each query's own candidates. Only keys, vectors and scores take part in the first stage; texts
    are joined to its few rows. Returns query_id, key, vec_rank, score, final, rank and the chunks' columns.
    """
    k = k or TOP_K
    hits = vector_hits(vectors, queries.select("query_id", F.col("vector").alias("query")), MULTIPLIER * k, where, post, key)
    hits = hits.select("query_id", key, F.col("rank").alias("vec_rank"))
    found = chunks.join(hits, key)
    scores = bm25_scores(found.select("query_id", key, "text"), queries.select("query_id", "query"), key, per_query=True)
    all_ = found.join(scores, ["query_id", key], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return decayed(all_, k, key, prior="vec_rank")


def overlap_score(query: Column, passage: Column) -> Column:
    """The share of the query's distinct tokens that a passage has: a stand-in where no relevance model is at hand."""
    asked = F.array_distinct(text.tokens(query))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(asked, text.tokens(passage))), F.size(asked)), F.lit(0.0))


def rerank(ranked: DataFrame, queries: DataFrame, k: int, score: Callable[[Column, Column], Column] = overlap_score, key: str = "doc_id") -> DataFrame:
    """The rows (query_id, key, rank, text) ordered anew by a relevance model on their first RERANK_CHARS characters, best k.

    A query that gets a null for any of its rows keeps its order.
    """
    rows = ranked.withColumnRenamed("rank", "prior").join(bounded(queries.select("query_id", "query")), "query_id")
    rows = rows.withColumn("relevance", score(F.col("query"), F.left(F.col("text"), F.lit(RERANK_CHARS))))
    own = Window.partitionBy("query_id")
    failed = F.count_if(F.col("relevance").isNull()).over(own) > 0
    rows = rows.withColumn("relevance", F.when(failed, F.lit(None)).otherwise(F.col("relevance")))
    return rows.withColumn("rank", F.row_number().over(own.orderBy(F.desc_nulls_last("relevance"), "prior", key))).filter(F.col("rank") <= k).drop("query")


def as_sources(rows: DataFrame) -> DataFrame:
    """Retrieved rows as citations."""
    return rows.select("query_id", "rank", "text", F.col("page_number").alias("page"), "bboxes", F.col("image_path").alias("image"))


def gate(scored: DataFrame, reply: Column, gate_at: float = 0.5, threshold: float = 0.35, enabled: bool = True) -> DataFrame:
    """Rows (bm25, ...) that are relevant, with relevant, score, reason and skipped.

    From gate_at on a row passes on its BM25 score alone; the others are judged by the model's reply and pass if it calls
    them relevant at threshold or more. Switched off, every row passes with score 1.
    """
    if not enabled:
        return scored.select("*", F.lit(True).alias("relevant"), F.lit(1.0).alias("score"), F.lit("").alias("reason"), F.lit(True).alias("skipped"))
    sure = F.coalesce(F.col("bm25") >= gate_at, F.lit(False))
    judged = scored.withColumn("_sure", sure).withColumn("_reply", F.when(~F.col("_sure"), text.parse_relevance(reply)))  # one pass; the sure ones aren't asked
    made = judged.select(
        *scored.columns, F.when(F.col("_sure"), True).otherwise(F.col("_reply.relevant") & (F.col("_reply.score") >= threshold)).alias("relevant"),
        F.when(F.col("_sure"), F.col("bm25")).otherwise(F.col("_reply.score")).alias("score"), F.when(F.col("_sure"), "").otherwise(F.col("_reply.reason")).alias("reason"), F.col("_sure").alias("skipped"),
    )
    return made.filter("relevant")


def table_first(rows: DataFrame, chunk_type: str = "chunk_type") -> DataFrame:
    """For each query its best row that is a table, or its best row where it has none; csv holds it as CSV."""
    best = Window.partitionBy("query_id").orderBy((F.col(chunk_type) != "table").cast("int"), "rank")
    return rows.withColumn("_k", F.row_number().over(best)).filter("_k = 1").drop("_k").withColumn("csv", text.table_to_csv(F.col("text")))


def summarise(queries: DataFrame, rows: DataFrame, empty: str = NO_SECTION) -> DataFrame:
    """For each query the texts of its rows in order, their boxes, and the first row's page and image; the text empty without rows."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "text", "bboxes", F.col("page_number").alias("page"), "image_path")))
    made = rows.groupBy("query_id").agg(ordered.alias("_r")).select(
        "query_id", F.array_join(F.col("_r.text"), "\n\n").alias("content"), F.flatten(F.col("_r.bboxes")).alias("bboxes"), F.get("_r", F.lit(0))["page"].alias("page"), F.get("_r", F.lit(0))["image_path"].alias("image")
    )
    return queries.select("query_id").join(made, "query_id", "left").withColumn("content", F.coalesce("content", F.lit(empty)))


def highlight(rows: DataFrame, page: Column, fallback: int = 3) -> DataFrame:
    """(query_id, bboxes): the boxes of each query's rows on a page, or of its first rows where none is on it."""
    on_page = F.count_if(F.col("page_number") == page).over(Window.partitionBy("query_id"))
    kept = rows.withColumn("_on", on_page).filter((F.col("page_number") == page) | ((F.col("_on") == 0) & (F.col("rank") <= fallback)))
    return kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "bboxes"))).alias("_r")).select("query_id", F.flatten(F.col("_r.bboxes")).alias("bboxes"))


def search(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """For each query its rows' texts with source notes as one listing; NO_RESULTS without rows."""
    line = text.render_result(F.col("text"), F.col("page_number"), F.col("bboxes"), F.col("image_path"))
    made = rows.withColumn("_line", line).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "_line"))).alias("_r"))
    made = made.select("query_id", text.render_sections(F.col("_r._line")).alias("content"))
    return queries.select("query_id").join(made, "query_id", "left").withColumn("content", F.coalesce("content", F.lit(NO_RESULTS)))
