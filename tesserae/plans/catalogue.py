"""Registered queries over the driver's tables, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..operators import answering, chunking, graph, retrieval, store
from ..sources import layout
from . import fixtures as fx

QUERY = "the of and with"
Q6 = lambda c: F.round(c, 6)

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def one_query(spark: SparkSession, words: str = QUERY) -> DataFrame:
    return spark.range(1).select(F.lit(0).cast("bigint").alias("query_id"), F.lit(words).alias("query"))


_TOKEN = "[\\p{L}\\p{N}_À-ɏ]+"
_STRIP = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
_BOOST = "1.0::DOUBLE / log2(CAST(greatest({0}, 1) + 1 AS DOUBLE))"


def _bm25(candidates: str, asked: str) -> str:
    """CTEs of BM25: candidates (query_id, id, text) and asked (query_id, query) are names of CTEs before it; scored has (query_id, id, score)."""
    return f"""toks AS (SELECT query_id, id, regexp_extract_all(lower(text), '{_TOKEN}') AS ts FROM {candidates}),
sizes AS (SELECT query_id, count(*) AS n, avg(CAST(len(ts) AS DOUBLE)) AS avgdl FROM toks GROUP BY 1),
terms AS (SELECT query_id, id, len(ts) AS dl, unnest(ts) AS term FROM toks),
tf AS (SELECT query_id, id, dl, term, count(*) AS f FROM terms GROUP BY ALL),
df AS (SELECT query_id, term, count(*) AS d FROM tf GROUP BY ALL),
idf AS (SELECT query_id, term, avgdl, ln(n - d + 0.5::DOUBLE) - ln(d + 0.5::DOUBLE) AS raw FROM df JOIN sizes USING (query_id)),
mean AS (SELECT query_id, avg(raw) AS m FROM idf GROUP BY 1),
want AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '{_TOKEN}')) AS term FROM {asked}) GROUP BY ALL),
scored AS (
  SELECT query_id, id, sum(times * CASE WHEN raw < 0 THEN 0.25::DOUBLE * m ELSE raw END * f * 2.5::DOUBLE / (f + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
  FROM tf JOIN idf USING (query_id, term) JOIN mean USING (query_id) JOIN want USING (query_id, term) GROUP BY ALL)"""


# Tokens and BM25


@query(f"SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_TOKEN}')) AS term FROM documents) GROUP BY 1")
def tokenize_terms(spark, d):
    rows = fx.table(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("ts"))
    return rows.select("doc_id", F.explode("ts").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("k")).groupBy("term").agg(F.sum("k").alias("n"), F.count("*").alias("docs"))


@query(f"WITH c AS (SELECT 0 AS query_id, doc_id AS id, text FROM documents), q AS (SELECT 0 AS query_id, '{QUERY}' AS query), {_bm25('c', 'q')} SELECT id AS doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM scored) WHERE rank <= 20")
def bm25_topk(spark, d):
    scored = retrieval.bm25_scores(fx.table(spark, d, "documents"), one_query(spark))
    top = scored.withColumn("_s", F.round("score", 9)).orderBy(F.desc("_s"), "doc_id").limit(20)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_s"), "doc_id"))).select("doc_id", Q6(F.col("score")).alias("score"), "rank")


@query(
    f"WITH {fx.LINES}, c AS (SELECT 0 AS query_id, doc_id * 100000 + elem_no AS id, text FROM lines), q AS (SELECT 0 AS query_id, '{QUERY}' AS query), {_bm25('c', 'q')}, "
    f"f AS (SELECT id, round(0.9::DOUBLE * score / (SELECT max(score) FROM scored) + 0.1::DOUBLE * {_BOOST.format('page_number')}, 6) AS final FROM scored JOIN lines ON id = doc_id * 100000 + elem_no) "
    "SELECT id, final, CAST(row_number() OVER (ORDER BY final DESC, id) AS INTEGER) AS rank FROM f QUALIFY rank <= 50"
)
def bm25_page_decay(spark, d):
    rows = fx.lines(spark, d).withColumn("id", F.col("doc_id") * 100000 + F.col("elem_no"))
    scored = retrieval.bm25_scores(rows, one_query(spark), "id").join(rows.select("id", "page_number"), "id")
    best = scored.agg(F.max("score").alias("best"))  # one row
    final = Q6(0.9 * F.col("score") / F.col("best") + 0.1 * text.page_boost(F.col("page_number")))
    top = scored.crossJoin(F.broadcast(best)).select("id", final.alias("final")).orderBy(F.desc("final"), "id").limit(50)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("final"), "id")))


# Vectors


def _hits(where: str = "", post: str = "", k: int = 10) -> str:
    n = k * 10 if post else k
    ranked = f"SELECT query_id, vec_id, label, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id) AS rank FROM s QUALIFY rank <= {n}"
    return f"""WITH u AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings {where}),
q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS w FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, label, list_inner_product(v, w) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(w, w))) AS score FROM u, q),
r AS ({ranked})
SELECT query_id, vec_id, score, label, CAST({"row_number() OVER (PARTITION BY query_id ORDER BY rank)" if post else "rank"} AS INTEGER) AS rank FROM r {post} {f"QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= {k}" if post else ""}"""


def _vector(spark, d, **how):
    return retrieval.vector_hits(fx.table(spark, d, "embeddings"), fx.probes(spark, d), 10, **how).withColumn("score", Q6(F.col("score")))


@query(_hits())
def vector_topk_batch(spark, d):
    return _vector(spark, d)


@query(_hits(k=1))
def vector_topk(spark, d):
    return retrieval.vector_hits(fx.table(spark, d, "embeddings"), fx.probes(spark, d), 1).withColumn("score", Q6(F.col("score")))


@query(_hits(where="WHERE label = 2"))
def vector_topk_filtered_pre(spark, d):
    return _vector(spark, d, where=F.col("label") == 2)


@query(_hits(post="WHERE label = 2"))
def vector_topk_filtered_post(spark, d):
    return _vector(spark, d, post=F.col("label") == 2)


_HYBRID = f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
w AS (SELECT vec_id AS query_id, v AS w FROM e WHERE vec_id % 50 = 0 AND vec_id IN (SELECT doc_id FROM documents)),
asked AS (SELECT vec_id AS query_id, text AS query FROM e JOIN documents ON vec_id = doc_id WHERE vec_id % 50 = 0),
cand AS (SELECT w.query_id, vec_id, row_number() OVER (PARTITION BY w.query_id ORDER BY list_inner_product(v, w) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(w, w))) DESC, vec_id) AS vr FROM e, w QUALIFY vr <= 60),
c AS (SELECT query_id, doc_id AS id, text, vr, n_chars FROM cand JOIN documents ON doc_id = vec_id),
{_bm25("c", "asked")},
f AS (SELECT c.query_id, c.id, vr, coalesce(score, 0.0::DOUBLE) AS s, 1 + n_chars // 3000 AS page FROM c LEFT JOIN scored USING (query_id, id)),
g AS (SELECT *, max(s) OVER (PARTITION BY query_id) AS best FROM f),
h AS (SELECT query_id, id, vr, round(CASE WHEN best > 0 THEN 0.9::DOUBLE * s / best + 0.1::DOUBLE * {_BOOST.format("page")} ELSE 0 END, 12) AS final FROM g)
SELECT query_id, id AS doc_id, round(final, 6) AS final, CAST(row_number() OVER (PARTITION BY query_id ORDER BY h.final DESC, vr, id) AS INTEGER) AS rank FROM h QUALIFY rank <= 15"""


def _retrieved(spark, d, k=15):
    docs = fx.table(spark, d, "documents")
    first = fx.probes(spark, d)
    asked = first.join(docs.select(F.col("doc_id").alias("query_id"), F.col("text").alias("words")), "query_id").select("query_id", F.col("words").alias("query"), F.col("query").alias("vector"))
    chunks = docs.withColumn("page_number", (1 + F.floor(F.col("n_chars") / 3000)).cast("int"))
    vectors = fx.table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return asked, retrieval.hybrid(chunks, vectors, asked, k)


@query(_HYBRID)
def hybrid_retrieve(spark, d):
    return _retrieved(spark, d)[1].select("query_id", "doc_id", Q6(F.col("final")).alias("final"), "rank")


@query(
    f"WITH hits AS ({_HYBRID}), "
    f"x AS (SELECT h.query_id, h.doc_id, h.rank AS prior, list_distinct(regexp_extract_all(lower(a.text), '{_TOKEN}')) AS asked, regexp_extract_all(lower(substr(d.text, 1, 512)), '{_TOKEN}') AS found "
    "FROM hits h JOIN documents d ON d.doc_id = h.doc_id JOIN documents a ON a.doc_id = h.query_id), "
    "y AS (SELECT *, CASE WHEN len(asked) = 0 THEN 0 ELSE CAST(len(list_intersect(asked, found)) AS DOUBLE) / len(asked) END AS share FROM x) "
    "SELECT query_id, doc_id, round(share, 6) AS relevance, prior, CAST(row_number() OVER (PARTITION BY query_id ORDER BY share DESC, prior, doc_id) AS INTEGER) AS rank FROM y QUALIFY rank <= 5"
)
def rerank_overlap(spark, d):
    asked, found = _retrieved(spark, d)
    return retrieval.rerank(found, asked, 5).select("query_id", "doc_id", Q6(F.col("relevance")).alias("relevance"), "prior", "rank")


@query("SELECT vec_id, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings")
def vector_norms(spark, d):
    return fx.table(spark, d, "embeddings").select("vec_id", Q6(geometry.norm(F.col("embedding"))).alias("norm"))


@query(
    "WITH f AS (SELECT label, first(embedding ORDER BY vec_id) AS e0 FROM embeddings GROUP BY label), x AS (SELECT e.label, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n, "
    "list_max(list_transform(range(1, 65), lambda i: abs(CAST(embedding[i] AS DOUBLE) - CAST(e0[i] AS DOUBLE)))) AS a FROM embeddings e JOIN f USING (label)) "
    "SELECT label, count(*) AS n, max(x.n) < 1e-6 OR (count(*) > 1 AND max(a) < 1e-6) AS broken FROM x GROUP BY label"
)
def broken_vectors(spark, d):
    return store.broken(fx.table(spark, d, "embeddings"), ["label"])


# Text rules


@query(
    f"WITH {fx.LINES}, s AS (SELECT doc_id, elem_no, {_STRIP('text')} AS t FROM lines) SELECT doc_id, elem_no, t = '' OR regexp_matches(t, '(?i)EVB-IT\\s+Dienst') OR regexp_matches(t, '(?i)^Seite\\s+\\d+\\s+von\\s+\\d+') "
    "OR regexp_matches(t, '(?i)Version\\s+\\d+\\.\\d+\\s+vom') OR regexp_matches(t, '(?i)Die mit \\* gekennzeichneten') OR regexp_matches(t, '^\\s*_+\\s*$') OR regexp_matches(t, '\\.{5,}') OR regexp_matches(t, '^\\d{1,2}\\s+von\\s+\\d{1,2}$') AS noise FROM s"
)
def noise_filter(spark, d):
    return fx.lines(spark, d).select("doc_id", "elem_no", text.is_noise(F.col("text")).alias("noise"))


@query(
    f"WITH {fx.LINES}, s AS (SELECT doc_id, elem_no, {_STRIP('text')} AS t FROM lines) SELECT doc_id, elem_no, regexp_replace(substr(lower(t), 1, 200), '\\s+', ' ', 'g') AS key FROM s WHERE length(t) >= 40 "
    "QUALIFY row_number() OVER (PARTITION BY doc_id, regexp_replace(substr(lower(t), 1, 200), '\\s+', ' ', 'g') ORDER BY elem_no) = 1"
)
def min_len_dedupe(spark, d):
    rows = fx.lines(spark, d).filter(F.length(text.strip(F.col("text"))) >= 40).select("doc_id", "elem_no", text.dedupe_key(F.col("text")).alias("key"))
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("elem_no"))).filter("_k = 1").drop("_k")


@query(
    "SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])(" + "|".join(text.GERMAN) + ")($|[^\\p{L}\\p{N}_])') THEN 'de' ELSE 'en' END AS lang, "
    + _STRIP("regexp_replace('<think>a' || chr(10) || 'b</think> ' || text || ' <think></think>', '<think>.*?</think>', '', 'gs')") + " AS plain FROM conversations"
)
def detect_language(spark, d):
    wrapped = F.concat(F.lit("<think>a\nb</think> "), "text", F.lit(" <think></think>"))
    return fx.table(spark, d, "conversations").select("conv_id", "turn", text.detect_language(F.col("text")).alias("lang"), text.strip_think(wrapped).alias("plain"))


_WRAPPED = "'FOUND SECTIONS (2 total — read all):' || chr(10) || chr(10) || '--- Abschnitt 1 ---' || chr(10) || text || chr(10) || '[source: page ' || (turn + 1) || ', bboxes=[[' || turn || '.0, 2.0, 3.0, 4.0]], image_path=''p' || turn || '.png'']' || chr(10) || chr(10) || '--- Abschnitt 2 ---' || chr(10) || ' x ' || text"


def _wrapped() -> Column:
    turn = F.col("turn").cast("string")
    return F.concat(
        F.lit("FOUND SECTIONS (2 total — read all):\n\n--- Abschnitt 1 ---\n"), "text", F.lit("\n[source: page "), (F.col("turn") + 1).cast("string"), F.lit(", bboxes=[["), turn,
        F.lit(".0, 2.0, 3.0, 4.0]], image_path='p"), turn, F.lit(".png']\n\n--- Abschnitt 2 ---\n x "), "text",
    )


@query(
    f"SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array({_WRAPPED}, '--- Abschnitt [0-9]+ ---'), lambda p: {_STRIP('p')}), lambda p: p <> '' AND NOT regexp_matches(p, '^(FOUND SECTIONS|GEFUNDENE ABSCHNITTE)')) AS sections FROM conversations"
)
def split_tool_output(spark, d):
    return fx.table(spark, d, "conversations").select("conv_id", "turn", text.split_sections(_wrapped()).alias("sections"))


@query(
    "SELECT conv_id, turn, " + _STRIP(f"regexp_replace(regexp_replace(regexp_replace({_WRAPPED}, '\\[source:.*?\\]|bboxes=\\[.*?\\]|image_path=[^\\n]*', '', 'gs'), '(?m)^FOUND SECTIONS.*$|^GEFUNDENE ABSCHNITTE.*$|^--- Abschnitt \\d+ ---$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')") .replace("{{3,}}", "{3,}") + " AS plain FROM conversations"
)
def strip_metadata(spark, d):
    return fx.table(spark, d, "conversations").select("conv_id", "turn", text.strip_metadata(_wrapped()).alias("plain"))


@query(
    f"WITH w AS (SELECT conv_id, turn, {_WRAPPED} AS t FROM conversations), m AS (SELECT conv_id, turn, regexp_extract(t, '\\[source: page (\\d+), bboxes=(\\[.*?\\]), image_path=''([^'']*)''', ['page', 'boxes', 'image'], 's') AS m FROM w) "
    "SELECT conv_id, turn, CAST(m.page AS INTEGER) AS page, CAST(CAST(m.boxes AS JSON) AS DOUBLE[][]) AS bboxes, m.image AS image FROM m WHERE m.page <> ''"
)
def extract_sources(spark, d):
    rows = fx.table(spark, d, "conversations").select("conv_id", "turn", F.explode(text.parse_sources(_wrapped())).alias("s"))
    return rows.select("conv_id", "turn", "s.*")


@query(
    "WITH t AS (SELECT conv_id, turn, text FROM conversations), r AS (SELECT conv_id, list(text || chr(10) || '[source: page ' || turn || ', bboxes=[[1.0, 2.0]], image_path=''p.png'']' ORDER BY turn) AS parts FROM t GROUP BY conv_id) "
    "SELECT conv_id AS query_id, 'FOUND SECTIONS (' || len(parts) || ' total — read all):' || chr(10) || chr(10) || array_to_string(list_transform(range(1, len(parts) + 1), lambda i: '--- Abschnitt ' || i || ' ---' || chr(10) || parts[i]), chr(10) || chr(10)) AS content FROM r"
)
def render_sections(spark, d):
    rows = fx.table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), "text", F.col("turn").alias("page_number"), F.array(F.array(F.lit(1.0), F.lit(2.0))).alias("bboxes"), F.lit("p.png").alias("image_path"))
    return retrieval.search(rows.select("query_id").distinct(), rows)


@query("SELECT conv_id, " + _STRIP("arg_max(text, turn)") + " AS question FROM conversations WHERE role = 'user' GROUP BY conv_id")
def last_question(spark, d):
    return answering.last_questions(answering.without_thinking(fx.table(spark, d, "conversations")))


@query("SELECT conv_id, CAST(count(*) FILTER (WHERE role = 'assistant' AND length(text) % 3 > 0) AS BIGINT) AS calls, count(*) FILTER (WHERE role = 'assistant' AND length(text) % 3 > 0) < 4 AS go_on FROM conversations GROUP BY conv_id")
def tool_call_count(spark, d):
    return answering.tool_calls(fx.table(spark, d, "conversations").withColumn("tool_calls", F.length("text") % 3))


@query("SELECT doc_id, 'passage: ' || text AS prefixed FROM documents")
def e5_prefix(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", text.prefixed(F.col("text"), "intfloat/multilingual-e5-small").alias("prefixed"))


@query(
    "WITH t AS (SELECT item_id, trim(replace(replace(text, chr(10), ' '), '|', '/')) AS b FROM benchmark), "
    "c AS (SELECT item_id, CASE WHEN regexp_matches(b, '[\",]') THEN '\"' || replace(b, '\"', '\"\"') || '\"' ELSE b END AS b FROM t) "
    "SELECT item_id, 'A,' || b || chr(13) || chr(10) || '\"x, \"\"y\"\"\",' || item_id || chr(13) || chr(10) AS csv FROM c"
)
def table_to_csv(spark, d):
    cell = F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("/"))
    return fx.table(spark, d, "benchmark").select("item_id", text.table_to_csv(F.concat(F.lit("| A | "), cell, F.lit(' |\n| --- | --- |\n| x, "y" | '), F.col("item_id").cast("string"), F.lit(" |"))).alias("csv"))


# Boxes

_BOX = "[CAST(l_linenumber * 10 AS DOUBLE), CAST(l_quantity AS DOUBLE), CAST(l_linenumber * 10 AS DOUBLE) + l_quantity, l_quantity + 20.0::DOUBLE]"


def _box() -> Column:
    x, q = (F.col("l_linenumber") * 10).cast("double"), F.col("l_quantity").cast("double")
    return F.array(x, q, x + q, q + 20.0)


@query(f"WITH b AS (SELECT l_orderkey, {_BOX} AS b FROM lineitem), v AS (SELECT * FROM b WHERE (b[3] - b[1]) * (b[4] - b[2]) >= 50) SELECT l_orderkey, [min(b[1]), min(b[2]), max(b[3]), max(b[4])] AS hull FROM v GROUP BY 1")
def bbox_union(spark, d):
    rows = fx.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(_box()).alias("boxes"))  # lines of one order
    return rows.filter(F.size(geometry.valid_boxes(F.col("boxes"))) > 0).select("l_orderkey", F.get(geometry.union_boxes(F.col("boxes"), F.slice("boxes", 1, 0)), F.lit(0)).alias("hull"))


@query(
    f"WITH b AS (SELECT l_orderkey, l_linenumber, {_BOX} AS a, [CAST(l_linenumber * 10 + 4 AS DOUBLE), l_quantity + 3, CAST(l_linenumber * 10 + 30 AS DOUBLE), l_quantity + 25] AS b FROM lineitem), "
    "c AS (SELECT *, greatest(least(a[3], b[3]) - greatest(a[1], b[1]), 0) * greatest(least(a[4], b[4]) - greatest(a[2], b[2]), 0) AS i FROM b) "
    "SELECT l_orderkey, l_linenumber, round(CASE WHEN (a[3]-a[1])*(a[4]-a[2]) + (b[3]-b[1])*(b[4]-b[2]) - i > 0 THEN i / ((a[3]-a[1])*(a[4]-a[2]) + (b[3]-b[1])*(b[4]-b[2]) - i) ELSE 0 END, 6) AS iou FROM c"
)
def bbox_iou(spark, d):
    x, q = (F.col("l_linenumber") * 10).cast("double"), F.col("l_quantity").cast("double")
    return fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", Q6(geometry.iou(_box(), F.array(x + 4, q + 3, x + 30, q + 25))).alias("iou"))


@query(f"SELECT l_orderkey, l_linenumber, list_transform({_BOX}, lambda x: round(x * 150.0::DOUBLE / 72.0::DOUBLE, 6)) AS scaled FROM lineitem")
def bbox_scale(spark, d):
    return fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.transform(geometry.scaled(_box()), Q6).alias("scaled"))


# Sources and routing


@query(f"WITH {fx.LINES} SELECT doc_id, page_number, round_even(avg(confidence), 4) AS confidence FROM lines GROUP BY ALL")
def page_confidence(spark, d):
    return layout.as_pages(fx.lines(spark, d)).select("doc_id", "page_number", layout.page_confidence(F.col("elements")).alias("confidence"))


@query(
    f"WITH {fx.LINES}, n AS (SELECT doc_id, page_number, count(*) AS m, list(bbox ORDER BY elem_no) AS bs FROM lines GROUP BY ALL), p AS (SELECT doc_id, page_number, elem_no, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY elem_no) - 1 AS i FROM lines WHERE elem_no % 10 < 4), "
    "k AS (SELECT doc_id, page_number, count(*) AS n FROM p GROUP BY ALL), x AS (SELECT p.*, m, n, bs, CAST(round_even(i * m / n, 0) AS INTEGER) AS f, CAST(round_even((i + 1) * m / n, 0) AS INTEGER) AS t FROM p JOIN n USING (doc_id, page_number) JOIN k USING (doc_id, page_number)), "
    "s AS (SELECT doc_id, page_number, i, CASE WHEN t > f THEN bs[f + 1:t] ELSE bs[least(i, m - 1) + 1:least(i, m - 1) + 1] END AS b FROM x) "
    "SELECT doc_id, page_number, CAST(i AS INTEGER) AS pos, [list_min(list_transform(b, lambda q: q[1])), list_min(list_transform(b, lambda q: q[2])), list_max(list_transform(b, lambda q: q[3])), list_max(list_transform(b, lambda q: q[4]))] AS bbox FROM s"
)
def bbox_bucket_enrich(spark, d):
    rows = fx.lines(spark, d)
    blocks = layout.as_pages(rows).select("doc_id", "page_number", F.col("elements.bbox").alias("boxes"))
    bare = layout.as_pages(rows.filter("elem_no % 10 < 4").withColumn("bbox", F.array(*[F.lit(0.0)] * 4)))
    return layout.fill_boxes(bare, blocks).select("doc_id", "page_number", F.posexplode("elements").alias("pos", "e")).select("doc_id", "page_number", "pos", "e.bbox")


@query(
    f"WITH {fx.LINES}, c AS (SELECT doc_id, page_number, o AS ord, round_even(avg(least(1.0::DOUBLE, confidence + (doc_id * 7 + page_number * 3 + o * 5) % 11 * 0.01::DOUBLE)), 4) AS conf FROM lines, (SELECT unnest([0, 1, 2]) AS o) GROUP BY ALL), "
    "b AS (SELECT *, max(conf) OVER (PARTITION BY doc_id, page_number ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c) "
    "SELECT doc_id, page_number, conf AS confidence, ord > 0 AS used_fallback, 'engine' || ord AS extractor FROM b WHERE before IS NULL OR before < 0.9 QUALIFY row_number() OVER (PARTITION BY doc_id, page_number ORDER BY conf DESC, ord) = 1"
)
def best_extractor(spark, d):
    pages = []
    for o in range(3):
        rows = fx.lines(spark, d).withColumn("confidence", F.least(F.lit(1.0), F.col("confidence") + (F.col("doc_id") * 7 + F.col("page_number") * 3 + o * 5) % 11 * 0.01))
        pages.append(layout.as_pages(rows).withColumn("ord", F.lit(o)).withColumn("extractor", F.lit(f"engine{o}")))
    return layout.route(pages[0].unionByName(pages[1]).unionByName(pages[2]), 0.9).drop("elements")


@query(
    f"WITH s AS (SELECT doc_id, unnest(string_split(replace(text, chr(10), chr(12)), chr(12))) AS t, generate_subscripts(string_split(replace(text, chr(10), chr(12)), chr(12)), 1) AS page FROM documents) SELECT doc_id, CAST(page AS INTEGER) AS page_number, {_STRIP('t')} AS text FROM s WHERE {_STRIP('t')} <> ''"
)
def page_split_formfeed(spark, d):
    return layout.pages_from_formfeeds(fx.table(spark, d, "documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\f"))))


@query(
    f"WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, '. ', '.' || chr(10) || chr(10)), '\\n{{2,}}'), lambda p: {_STRIP('p')}), lambda p: length(p) >= 2) AS ps, {_STRIP('text')} AS whole FROM documents), "
    "t AS (SELECT doc_id, CASE WHEN len(ps) > 0 THEN ps WHEN whole <> '' THEN [whole] ELSE [] END AS ps FROM s) SELECT doc_id, CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS elem_no, unnest(ps) AS text FROM t"
)
def paragraph_split(spark, d):
    pages = fx.table(spark, d, "documents").select("doc_id", F.lit(1).alias("page_number"), F.replace("text", F.lit(". "), F.lit(".\n\n")).alias("text"))
    return layout.paragraphs(pages).select("doc_id", "elem_no", "text")


@query(
    f"WITH l AS (SELECT doc_id, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS ls FROM documents), p AS (SELECT doc_id, ls, greatest(1, len(ls) // 3) AS per, unnest([1, 2, 3]) AS page FROM l), "
    f"t AS (SELECT doc_id, page, {_STRIP('array_to_string(CASE WHEN page < 3 THEN ls[(page - 1) * per + 1:page * per] ELSE ls[(page - 1) * per + 1:] END, chr(0))')} AS text FROM p) SELECT doc_id, CAST(page AS INTEGER) AS page_number, replace(text, chr(0), '') AS text FROM t WHERE replace(text, chr(0), '') <> ''"
)
def even_line_split(spark, d):
    return layout.pages_from_lines(fx.table(spark, d, "documents"), F.lit(3))


@query(
    f"WITH {fx.LINES} SELECT count(*) AS chunks, count(DISTINCT doc_id) AS documents, count(*) FILTER (WHERE elem_no % 4 = 0) AS without_box, count(*) AS without_image FROM lines"
)
def quality_metrics(spark, d):
    box = F.when(F.col("elem_no") % 4 == 0, F.array(*[F.lit(0.0)] * 4)).otherwise(F.col("bbox"))
    return store.stats(fx.lines(spark, d).withColumn("bboxes", F.array(box)))


# Chunks


@query(
    f"WITH RECURSIVE {fx.LINES}, o AS (SELECT doc_id, elem_no, length(text) AS n FROM lines), g(doc_id, elem_no, size, grp) AS (SELECT doc_id, elem_no, n, 0 FROM o WHERE elem_no = 0 UNION ALL "
    "SELECT o.doc_id, o.elem_no, CASE WHEN size > 0 AND size + n > 1000 THEN n ELSE size + n END, grp + CASE WHEN size > 0 AND size + n > 1000 THEN 1 ELSE 0 END FROM g JOIN o ON o.doc_id = g.doc_id AND o.elem_no = g.elem_no + 1) "
    "SELECT doc_id, elem_no, CAST(grp AS INTEGER) AS grp FROM g"
)
def pack_lines(spark, d):
    return chunking.packed(fx.lines(spark, d).select("doc_id", "elem_no", "text"), ["doc_id"], ["elem_no"], 1000, F.length("text")).select("doc_id", "elem_no", F.col("group").alias("grp"))


@query(
    f"WITH {fx.LINES}, n AS (SELECT *, lead(text) OVER w AS t2, lead(type) OVER w AS y2, lead(confidence) OVER w AS c2, lead(bbox) OVER w AS b2 FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY elem_no)), "
    f"j AS (SELECT doc_id, elem_no, type, y2, {_STRIP('substr(text, greatest(length(text) - 199, 1))')} AS a, {_STRIP('substr(t2, 1, 200)')} AS b, least(confidence, c2) AS confidence, "
    "[[least(bbox[1], b2[1]), least(bbox[2], b2[2]), greatest(bbox[3], b2[3]), greatest(bbox[4], b2[4])]] AS bboxes FROM n WHERE t2 IS NOT NULL) "
    "SELECT doc_id, elem_no * 2 + 1 AS ord, a || ' ' || b AS text, bboxes, confidence FROM j WHERE type <> 'table' AND y2 <> 'table' AND a <> '' AND b <> '' AND length(a || ' ' || b) >= 40"
)
def overlap_bridge(spark, d):
    chunks = fx.lines(spark, d).select("doc_id", F.col("elem_no").alias("ord"), "text", F.array("bbox").alias("bboxes"), F.col("type").alias("chunk_type"), "confidence")
    return chunking.bridges(chunks).filter("chunk_type = 'overlap'").drop("chunk_type")


# Sections and the graph


@query(f"WITH {fx.SECTIONED} SELECT doc_id, chunk_id, label, section FROM placed")
def section_labels(spark, d):
    return graph.labelled(fx.sectioned(spark, d)).select("doc_id", "chunk_id", "label", "section")


@query(f"WITH {fx.SECTIONED} SELECT doc_id, label, title, page, level, parent, first_chunk FROM sections")
def section_level_parent(spark, d):
    return graph.sections(graph.labelled(fx.sectioned(spark, d)))


@query(f"WITH {fx.SECTIONED} SELECT doc_id, chunk_id, regexp_extract_all(text, '§\\s*(\\d+(?:\\.\\d+)*)', 1) AS refs FROM chunks")
def cross_refs(spark, d):
    return fx.sectioned(spark, d).select("doc_id", "chunk_id", text.references(F.col("text")).alias("refs"))


_NODES = """SELECT doc_id, 'chunk_' || chunk_id AS id, 'chunk' AS node_type, chunk_id AS chunk_index, page_number AS page, chunk_type, substr(text, 1, 80) AS text_preview, NULL::VARCHAR AS label, NULL::VARCHAR AS title, NULL::INTEGER AS level FROM chunks
UNION ALL SELECT doc_id, 'sec_' || label, 'section', NULL, page, NULL, NULL, label, title, level FROM sections"""
_EDGES = """SELECT doc_id, 'chunk_' || chunk_id AS src, 'sec_' || section AS dst, 'chunk_of' AS edge_type, 0 AS ord FROM placed WHERE section IS NOT NULL
UNION ALL SELECT s.doc_id, 'sec_' || s.label, 'sec_' || s.parent, 'subsection_of', 0 FROM sections s JOIN sections p ON p.doc_id = s.doc_id AND p.label = s.parent AND p.first_chunk < s.first_chunk
UNION ALL SELECT r.doc_id, 'chunk_' || chunk_id, 'sec_' || ref, 'references', CAST(min(pos) AS INTEGER) FROM (
  SELECT doc_id, chunk_id, section, unnest(regexp_extract_all(text, '§\\s*(\\d+(?:\\.\\d+)*)', 1)) AS ref, generate_subscripts(regexp_extract_all(text, '§\\s*(\\d+(?:\\.\\d+)*)', 1), 1) - 1 AS pos FROM placed) r
  JOIN sections s ON s.doc_id = r.doc_id AND s.label = ref WHERE section IS NULL OR section <> ref GROUP BY r.doc_id, chunk_id, ref
UNION ALL SELECT doc_id, 'chunk_' || chunk_id, 'chunk_' || nxt, 'sequential', 0 FROM (SELECT doc_id, chunk_id, page_number, lead(chunk_id) OVER w AS nxt, lead(page_number) OVER w AS np FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_id)) WHERE np = page_number"""


@query(f"WITH {fx.SECTIONED} {_NODES}")
def graph_nodes(spark, d):
    return graph.nodes(fx.sectioned(spark, d))


@query(f"WITH {fx.SECTIONED} {_EDGES}")
def graph_edges(spark, d):
    return graph.edges(fx.sectioned(spark, d))


@query(f"WITH {fx.SECTIONED}, n AS ({_NODES}), e AS ({_EDGES}) SELECT node_type AS kind, count(*) AS n FROM n GROUP BY 1 UNION ALL SELECT edge_type, count(*) FROM e GROUP BY 1")
def graph_stats(spark, d):
    chunks = fx.sectioned(spark, d)
    return graph.stats(graph.nodes(chunks), graph.edges(chunks))


_EXPAND = f"""WITH {fx.SECTIONED}, e AS ({_EDGES}),
seeds AS (SELECT doc_id AS query_id, doc_id, chunk_id, CAST(chunk_id // 11 + 1 AS INTEGER) AS rank FROM chunks WHERE chunk_id % 11 = 4),
members AS (SELECT doc_id, dst AS sec, CAST(substr(src, 7) AS INTEGER) AS found FROM e WHERE edge_type = 'chunk_of'),
hops AS (SELECT s.*, e.dst, e.edge_type, e.ord FROM seeds s JOIN e ON e.doc_id = s.doc_id AND e.src = 'chunk_' || s.chunk_id),
cand AS (
  SELECT query_id, doc_id, chunk_id, 0 AS late, rank, 0 AS step, 0 AS ord, 0 AS last FROM seeds
  UNION ALL SELECT query_id, h.doc_id, found, 1, rank, CASE edge_type WHEN 'chunk_of' THEN 1 ELSE 2 END, ord, found FROM hops h JOIN members m ON m.doc_id = h.doc_id AND m.sec = h.dst WHERE edge_type IN ('chunk_of', 'references')
  UNION ALL SELECT query_id, doc_id, CAST(substr(dst, 7) AS INTEGER), 1, rank, 3, ord, CAST(substr(dst, 7) AS INTEGER) FROM hops WHERE edge_type = 'sequential'),
best AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY query_id, doc_id, chunk_id ORDER BY late, rank, step, ord, last) = 1)
SELECT query_id, doc_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY late, rank, step, ord, last, doc_id, chunk_id) AS INTEGER) AS pos FROM best QUALIFY pos <= 25"""


@query(_EXPAND)
def graph_expand(spark, d):
    chunks = fx.sectioned(spark, d)
    seeds = chunks.filter("chunk_id % 11 = 4").select(F.col("doc_id").alias("query_id"), "doc_id", "chunk_id", (F.floor(F.col("chunk_id") / 11) + 1).cast("int").alias("rank"))
    return graph.expand(seeds, graph.edges(chunks))


# Document types, routing, context

WORDS = {"de": "der und die den nicht mit sich das".split(), "en": "the of and to that with this was".split(), "es": "los que las del para con una por".split(), "fr": "les des une que pour dans est qui".split()}


def _hits_sql(column: str, words: list[str]) -> str:
    return " + ".join(f"CAST(contains(lower({column}), '{w.lower()}') AS INTEGER)" for w in words)


def _best_sql(source: str, column: str, words: dict[str, list[str]], least: int, fallback: str) -> str:
    scores = ", ".join(f"struct_pack(s := {_hits_sql(column, w)}, o := -{i}, n := '{k}')" for i, (k, w) in enumerate(words.items()))
    return f"SELECT *, list_max([{scores}]) AS b, CASE WHEN list_max([{scores}]).s >= {least} THEN list_max([{scores}]).n ELSE '{fallback}' END AS name FROM {source}"


_SAMPLE = f"{fx.LINES}, smp AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY elem_no) AS text FROM lines WHERE elem_no < 15 GROUP BY 1)"


@query(f"WITH {_SAMPLE} SELECT doc_id, name AS doc_type, b.s AS score FROM ({_best_sql('smp', 'text', WORDS, 3, 'fallback')})")
def classify_doc(spark, d):
    return answering.classify(fx.lines(spark, d).withColumn("chunk_id", F.col("elem_no")), WORDS)


@query(f"WITH {_SAMPLE} SELECT doc_id, " + ", ".join(f"{_hits_sql('text', w)} AS {k}" for k, w in WORDS.items()) + " FROM smp")
def doc_type_scores(spark, d):
    first = fx.lines(spark, d).filter("elem_no < 15").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("elem_no", "text"))).alias("c")).select("doc_id", F.array_join(F.col("c.text"), "\n").alias("text"))
    scored = answering.keyword_scores(first, WORDS)
    return scored.select("doc_id", *(F.get("scores", F.lit(i))["score"].alias(k) for i, k in enumerate(WORDS)))


@query(f"SELECT item_id AS query_id, query, name AS domain, CASE WHEN b.s >= 1 THEN b.s ELSE 0 END AS score FROM ({_best_sql('(SELECT item_id, text AS query FROM benchmark)', 'query', WORDS, 1, 'general')})")
def route_domain(spark, d):
    return answering.route(fx.questions(spark, d), WORDS)


@query(
    "WITH RECURSIVE m AS (SELECT conv_id, turn, text, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS k FROM conversations), g(conv_id, k, turn, total, kept) AS ("
    "SELECT conv_id, k, turn, CASE WHEN n <= 600 THEN n ELSE 0 END, n <= 600 FROM m WHERE k = 1 UNION ALL SELECT m.conv_id, m.k, m.turn, CASE WHEN total + n <= 600 THEN total + n ELSE total END, total + n <= 600 FROM g JOIN m ON m.conv_id = g.conv_id AND m.k = g.k + 1) "
    "SELECT g.conv_id, list(text ORDER BY g.turn) FILTER (WHERE kept) AS kept FROM g JOIN m USING (conv_id, turn) GROUP BY 1 HAVING bool_or(kept)"
)
def context_trim(spark, d):
    rows = fx.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("m"))
    return rows.select("conv_id", answering.trim(F.col("m.text"), 600).alias("kept")).filter("size(kept) > 0")


@query(
    "SELECT event_id, round(value / 1000, 6) AS bm25, true AS relevant, CASE WHEN value / 1000 >= 0.5 THEN round(value / 1000, 6) ELSE round((event_id % 10) / 10.0::DOUBLE, 6) END AS score, value / 1000 >= 0.5 AS skipped "
    "FROM events WHERE value / 1000 >= 0.5 OR (event_id % 3 <> 0 AND (event_id % 10) / 10.0::DOUBLE >= 0.35)"
)
def self_rag_gate(spark, d):
    rows = fx.table(spark, d, "events").select("event_id", (F.col("value") / 1000).alias("bm25"))
    reply = F.concat(F.lit('```json\n{"relevant": '), F.when(F.col("event_id") % 3 != 0, "true").otherwise("false"), F.lit(', "score": '), ((F.col("event_id") % 10) / 10.0).cast("string"), F.lit(', "reason": "r"}\n```'))
    return retrieval.gate(rows, reply).select("event_id", Q6(F.col("bm25")).alias("bm25"), "relevant", Q6(F.col("score")).alias("score"), "skipped")


@query("SELECT event_id, event_id % 4 <> 1 AS relevant, CASE WHEN event_id % 4 <= 1 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS score, CASE event_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'parse error' ELSE '' END AS reason FROM events")
def self_rag_parse(spark, d):
    k = F.col("event_id") % 4
    reply = F.when(k == 0, '{"relevant": true, "score": 0.25, "reason": "a"}').when(k == 1, '```\n{"relevant": false, "score": 0.25, "reason": "b"}\n```').when(k == 2, "no JSON").otherwise("{}")
    return fx.table(spark, d, "events").select("event_id", text.parse_relevance(reply).alias("r")).select("event_id", "r.*")


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, 'xx', source, n_chars + 1 FROM documents WHERE doc_id % 5 = 0 AND doc_id % 2 = 0 UNION ALL SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id % 5 = 0 AND doc_id % 2 = 1")
def upsert_docs(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    new = docs.filter("doc_id % 10 = 0").withColumn("lang", F.lit("xx")).withColumn("n_chars", F.col("n_chars") + 1)
    return store.upserted(docs, new)


@query("SELECT conv_id AS query_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS content, flatten(list([[CAST(turn AS DOUBLE), 1.0::DOUBLE]] ORDER BY turn)) AS bboxes, arg_min(turn, turn) AS page, 'p.png' AS image FROM conversations GROUP BY 1")
def summarize_section(spark, d):
    rows = _as_hits(spark, d)
    return retrieval.summarise(rows.select("query_id").distinct(), rows)


def _as_hits(spark, d):
    return fx.table(spark, d, "conversations").select(
        F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), "text", F.col("turn").alias("page_number"), F.array(F.array(F.col("turn").cast("double"), F.lit(1.0))).alias("bboxes"), F.lit("p.png").alias("image_path"), F.when(F.length("text") % 5 == 0, "table").otherwise("text").alias("chunk_type")
    )


@query(
    "WITH r AS (SELECT conv_id, turn, count(*) FILTER (WHERE turn = 2) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id AS query_id, flatten(list([[CAST(turn AS DOUBLE), 1.0::DOUBLE]] ORDER BY turn)) AS bboxes FROM r WHERE turn = 2 OR (n = 0 AND turn <= 3) GROUP BY 1"
)
def highlight_section(spark, d):
    return retrieval.highlight(_as_hits(spark, d), F.lit(2))


@query("SELECT conv_id AS query_id, turn AS rank, text AS csv FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY length(text) % 5 <> 0, turn) = 1")
def table_first(spark, d):
    return retrieval.table_first(_as_hits(spark, d).withColumn("text", F.replace("text", F.lit("|"), F.lit("|")))).select("query_id", "rank", "csv")


@query("SELECT conv_id AS query_id, turn AS rank, text, turn AS page, [[CAST(turn AS DOUBLE), 1.0::DOUBLE]] AS bboxes, 'p.png' AS image FROM conversations")
def retrieve_as_sources(spark, d):
    return retrieval.as_sources(_as_hits(spark, d))


@query("SELECT doc_id, contains(text, 'token') OR contains(text, 'License') AS hit FROM documents")
def keyword_filter(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", text.contains_any(F.col("text"), ["token", "License"]).alias("hit"))


from . import more  # noqa: E402, F401  the queries of sources, chunks and sessions
