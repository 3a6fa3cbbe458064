"""Documents in, cited answers out: the whole way, as tables and for batches of questions."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import answering, chunking, graph, retrieval, store

LOG = logging.getLogger(__name__)
#: Rows that each tool retrieves.
SEARCH_K, TABLE_K, TABLE_FALLBACK_K, SUMMARY_K, HIGHLIGHT_K, PAGE_FALLBACK = 8, 5, 3, 4, 10, 3
#: Characters of a chunk that its relevance is judged by.
GATE_CHARS = 800


@dataclass
class Index:
    """The tables of indexed documents."""

    chunks: DataFrame  # doc_id, chunk_id, text, page_number, bboxes, chunk_type, confidence, image_path, embedding
    types: DataFrame  # doc_id, doc_type, score
    nodes: DataFrame | None
    edges: DataFrame | None


def index(elements: DataFrame, limit: int = 1000, embedder: Callable | None = None, model: str = "hashed", hints: dict | None = None, reply: Column | None = None) -> Index:
    """Element rows as chunks with vectors, document types and the section graph. Each table is computed when it is read."""
    chunks = chunking.chunk(elements, limit)
    return Index(store.with_units(store.embed(chunks, model, embedder)), answering.classify(chunks, hints, reply), graph.nodes(chunks), graph.edges(chunks))


def write(made: Index, path: str, hints: dict | None = None, reply: Column | None = None) -> None:
    """Writes all tables. Chunks are made once and written; types and graph come from the written chunks, postings too."""
    made.chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    chunks = made.chunks.sparkSession.read.parquet(f"{path}/chunks")
    answering.classify(chunks, hints, reply).write.mode("overwrite").parquet(f"{path}/types")
    graph.save(graph.nodes(chunks), graph.edges(chunks), path)
    retrieval.write_postings(retrieval.postings(keyed(chunks), "_key"), f"{path}/postings")


def keyed(chunks: DataFrame) -> DataFrame:
    """Chunks with a key of their own, which sorts by document and place."""
    return chunks.withColumn("_key", F.concat_ws("\x01", F.col("doc_id").cast("string"), F.lpad(F.col("chunk_id").cast("string"), 10, "0")))


def load(spark: SparkSession, path: str) -> Index:
    """The written tables. Without a graph there is nothing to expand along, and answers go on without it."""
    try:
        nodes, edges = graph.load(spark, path)
    except AnalysisException:
        nodes = edges = None
    return Index(spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/types"), nodes, edges)


def asked(questions: DataFrame, embedder: Callable | None = None, model: str = "hashed") -> DataFrame:
    """Questions (query_id, query) with their vector."""
    rows = store.embed(questions.select("query_id", F.col("query").alias("text")), model, embedder, kind="query")
    return rows.select("query_id", F.col("text").alias("query"), F.col("embedding").alias("vector"))


def retrieve(made: Index, queries: DataFrame, k: int = retrieval.TOP_K, where: Column | None = None, post: Column | None = None, rerank: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """The best k chunks for each of the queries (query_id, query, vector), by rank, with the chunks' columns."""
    chunks = keyed(made.chunks.drop("embedding"))
    vectors = keyed(made.chunks).select("_key", "embedding", "doc_id", "chunk_type")
    found = retrieval.hybrid(chunks, vectors, queries, k, "_key", where, post)
    return (found if rerank is None else retrieval.rerank(found, queries, k, rerank, "_key")).drop("_key")


def expanded(made: Index, hits: DataFrame, most: int = graph.MAX_EXPANDED) -> DataFrame:
    """Hits and what they lead to in their documents' graphs; rank is the new order. Without a usable graph the hits alone."""
    try:
        if made.edges is None:
            raise LookupError("no graph")
        more = graph.expand(hits.select("query_id", "rank", "doc_id", "chunk_id"), made.edges, most)
    except (AnalysisException, LookupError) as e:
        LOG.warning("not expanded: %s", e)
        return made.chunks.drop("embedding").join(hits.select("query_id", "rank", "doc_id", "chunk_id"), ["doc_id", "chunk_id"])
    return made.chunks.drop("embedding").join(more.withColumnRenamed("pos", "rank"), ["doc_id", "chunk_id"])


def search_term(made: Index, queries: DataFrame, reply: Column | None = None, gate: float = 0.5) -> DataFrame:
    """(query_id, content): the sections for each query, expanded along the graph; judged for relevance where replies are given."""
    hits = retrieve(made, queries, SEARCH_K)
    if reply is not None:
        hits = retrieval.gate(hits.withColumn("bm25", F.col("final")).withColumn("judged", F.left("text", F.lit(GATE_CHARS))).drop("score"), reply, gate).drop("score", "relevant", "reason", "skipped", "judged", "bm25")
    return retrieval.search(queries, expanded(made, hits))


def extract_table(made: Index, queries: DataFrame) -> DataFrame:
    """(query_id, content): the best table for each query as CSV, else the best chunk as it is."""
    tables = retrieve(made, queries, TABLE_K, post=F.col("chunk_type") == "table")
    other = retrieve(made, queries, TABLE_FALLBACK_K).join(tables.select("query_id").distinct(), "query_id", "left_anti")
    best = retrieval.table_first(tables.unionByName(other, allowMissingColumns=True))
    shown = best.select("query_id", text.render_result(F.col("csv"), F.col("page_number"), F.col("bboxes"), F.col("image_path")).alias("content"))
    return queries.select("query_id").join(shown, "query_id", "left").withColumn("content", F.coalesce("content", F.lit(retrieval.NO_TABLE)))


def summarise_section(made: Index, titles: DataFrame) -> DataFrame:
    """(query_id, content, bboxes, page, image): the text of the section for each title."""
    return retrieval.summarise(titles, expanded(made, retrieve(made, titles, SUMMARY_K)), retrieval.NO_SECTION)


def highlight_section(made: Index, queries: DataFrame, page: Column) -> DataFrame:
    """(query_id, bboxes): where each query's text stands on a page."""
    return retrieval.highlight(retrieve(made, queries, HIGHLIGHT_K), page, PAGE_FALLBACK)


def ask(made: Index, questions: DataFrame, answer: Callable[[Column], Column] | None = None, embedder: Callable | None = None, limit: int = answering.CONTEXT_CHARS) -> DataFrame:
    """(query_id, prompt, answer, sources) for questions (query_id, query); sources: page, bboxes and image, one a page.

    answer turns a prompt column into a reply column, a model's thinking included; without it the answer is the context.
    """
    queries = asked(questions, embedder)
    found = search_term(made, queries)
    parts = text.split_sections(F.col("content"))
    fitting = answering.trim(F.col("_parts"), limit)
    rows = questions.join(found, "query_id").withColumn("_parts", parts).withColumn("_fit", fitting)
    chosen = F.when(F.size("_fit") > 0, F.col("_fit")).otherwise(F.slice("_parts", 1, 5))
    rows = rows.withColumn("context", F.array_join(F.transform(chosen, lambda s: text.strip_metadata(s)), "\n\n---\n\n"))
    rows = rows.withColumn("prompt", text.answer_prompt(F.col("query"), F.col("context")))
    rows = rows.withColumn("answer", F.col("context") if answer is None else text.strip_think(answer(F.col("prompt"))))
    first = text.parse_sources(F.col("content"))
    pages = F.array_distinct(F.transform(first, lambda s: s["page"]))
    sources = F.slice(F.transform(pages, lambda p: F.get(F.filter(first, lambda s: s["page"] == p), F.lit(0))), 1, answering.MAX_SOURCES)
    return rows.select("query_id", "prompt", "answer", sources.alias("sources"))
