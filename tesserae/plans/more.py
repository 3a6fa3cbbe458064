"""Registered queries over sources, chunks, the store, sessions and models, and their SQL for DuckDB."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text
from ..operators import answering, chunking, graph, retrieval, store
from ..sources import image, layout
from . import fixtures as fx
from . import lifecycle, sessions
from .catalogue import _EDGES, _NODES, _SAMPLE, _STRIP, _WRAPPED, Q6, WORDS, _best_sql, _wrapped, query


# Layout JSON


@query(f"SELECT doc_id, 1 AS page_number, 0 AS elem_no, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: {_STRIP('l')}), lambda l: l <> ''), chr(10)) AS text, 0.9::DOUBLE AS confidence FROM documents WHERE length({_STRIP('text')}) >= 3")
def layout_lists(spark, d):
    """Each document as a list whose every line is an item within the line before it."""
    opened = F.transform(F.split("text", "\n"), lambda x: F.concat(F.rtrim(F.to_json(F.struct(x.alias("content"))), F.lit("}")), F.lit(',"list items":[')))
    body = F.concat(F.lit('{"kids":[{"type":"list","page number":1,"bounding box":[0,0,100,20],"list items":['), F.array_join(opened, ""), F.repeat(F.lit("]}"), F.size(opened)), F.lit("]}]}"))
    docs = fx.table(spark, d, "documents").select("doc_id", body.alias("json"))
    return layout.as_elements(layout.layout_pages(docs)).select("doc_id", "page_number", "elem_no", "text", "confidence")


@query(
    f"WITH {fx.LINES}, k AS (SELECT doc_id, elem_no, page_number + CASE WHEN page_number % 2 = 1 THEN 2 ELSE 0 END AS page_number, {_STRIP('text')} AS t, elem_no % 5 AS m FROM lines WHERE elem_no % 11 <> 5), "
    "s AS (SELECT *, replace(t, '|', '\\|') AS cell FROM k), "
    "r AS (SELECT doc_id, page_number, elem_no, CASE WHEN m = 3 THEN 'table' ELSE 'text' END AS type, CASE m WHEN 3 THEN '| k | ' || CASE WHEN cell = '' THEN ' ' ELSE cell END || ' |' || chr(10) || '| --- | --- |' || chr(10) || '|   | ' || CASE WHEN cell = '' THEN 'x x' ELSE cell || ' x' END || ' |' "
    "WHEN 2 THEN CASE WHEN t = '' THEN 'inner' ELSE t || chr(10) || 'inner' END ELSE t END AS text, CASE m WHEN 0 THEN 0.95::DOUBLE WHEN 2 THEN 0.9::DOUBLE WHEN 3 THEN 0.85::DOUBLE WHEN 1 THEN 0.92::DOUBLE ELSE 0.92::DOUBLE END AS confidence FROM s) "
    "SELECT doc_id, page_number, CAST(row_number() OVER (PARTITION BY doc_id, page_number ORDER BY elem_no) - 1 AS INTEGER) AS elem_no, type, text, confidence FROM r WHERE length(text) >= 3"
)
def layout_json(spark, d):
    """Lines as headings, paragraphs, lists, tables and elements without a type; some without a box; odd pages are labelled two pages on."""
    i, t = F.col("elem_no"), F.col("text")
    node = lambda c: F.struct(c.alias("content"))
    cells = lambda *cs: F.struct(F.array(*cs).alias("cells"))
    cell = lambda c, n, inner=None: F.struct(c.alias("content"), F.lit(n).alias("column number"), (F.lit(None).cast("array<struct<content:string>>") if inner is None else inner).alias("list items"))
    empty = F.struct(F.array().cast("array<struct<content:string,`column number`:int,`list items`:array<struct<content:string>>>>").alias("cells"))
    rows = F.array(cells(cell(t, 2), cell(F.lit("k"), 1)), empty, cells(cell(F.lit(""), 1), cell(F.lit(" "), 2, F.array(node(F.when(text.strip(t) == "", F.lit("x")).otherwise(t)), node(F.lit("x"))))))
    kid = F.struct(
        F.when(i % 5 == 4, F.lit(None)).otherwise(F.element_at(F.array(*map(F.lit, ("Heading", "paragraph", "list", "table", ""))), i % 5 + 1)).alias("type"),
        F.when(i % 5 != 3, F.concat(F.lit(" "), t)).alias("content"), F.col("page_number").alias("page number"), F.when(i % 11 != 5, F.array(F.lit(0), F.lit(0), F.lit(100), F.lit(20))).alias("bounding box"),
        F.when(i % 5 == 2, F.array(node(F.lit("inner")))).alias("list items"), F.when(i % 5 == 3, rows).alias("rows"),
    )
    lines = fx.lines(spark, d)
    docs = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("elem_no", kid.alias("kid")))).alias("x")).select("doc_id", F.to_json(F.struct(F.col("x.kid").alias("kids"))).alias("json"))
    pages = lines.select("doc_id", "page_number").distinct()
    labels = pages.select("doc_id", (F.col("page_number") + F.when(F.col("page_number") % 2 == 1, 2).otherwise(0)).alias("physical"), F.when(F.col("page_number") % 2 == 1, F.col("page_number").cast("string")).otherwise("x").alias("label"))
    return layout.as_elements(layout.layout_pages(docs, labels)).select("doc_id", "page_number", "elem_no", "type", "text", "confidence")


# Files


def _pdf(lines: Column) -> Column:
    """A PDF file of one page with a text object for each line."""
    shown = F.transform(lines, lambda x, i: F.concat(F.lit("BT /F1 10 Tf 72 "), (F.lit(700) - 20 * i).cast("string"), F.lit(" Td ("), F.regexp_replace(x, r"([\\()])", r"\\$1"), F.lit(") Tj ET")))
    body = F.array_join(shown, "\n")
    return F.concat(
        F.lit("%PDF-1.4\n1 0 obj\n<</Type/Catalog/Pages 2 0 R>>\nendobj\n2 0 obj\n<</Type/Pages/Kids[3 0 R]/Count 1>>\nendobj\n3 0 obj\n<</Type/Page/Parent 2 0 R/MediaBox[0 0 595 842]/Contents 4 0 R>>\nendobj\n4 0 obj\n<</Length "),
        F.length(body).cast("string"), F.lit(">>\nstream\n"), body, F.lit("\nendstream\nendobj\ntrailer\n<</Root 1 0 R>>\n%%EOF\n"),
    )


_PDF_LINES = "FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents) WHERE doc_id % 7 <> 3"


@query(
    f"WITH l AS (SELECT doc_id, pos, regexp_replace(raw, '[^ -~]', '?', 'g') AS raw {_PDF_LINES}), t AS (SELECT *, trim(regexp_replace(raw, ' +', ' ', 'g')) AS text FROM l), e AS (SELECT unnest(['blocks', 'layout']) AS engine), "
    "n AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS elem_no FROM t WHERE raw <> '') "
    "SELECT engine, doc_id, 1 AS page_number, elem_no, text, [72.0::DOUBLE, 132.0::DOUBLE + 20 * pos, 72.0::DOUBLE + 5 * length(raw), 144.0::DOUBLE + 20 * pos] AS bbox, CASE engine WHEN 'blocks' THEN 0.9::DOUBLE ELSE 0.88::DOUBLE END AS confidence, NULL::VARCHAR AS error "
    "FROM n, e WHERE length(text) >= CASE engine WHEN 'blocks' THEN 3 ELSE 1 END UNION ALL SELECT engine, doc_id, NULL, NULL, NULL, NULL, NULL, 'ValueError: no PDF file' FROM documents, e WHERE doc_id % 7 = 3"
)
def pdf_scan(spark, d):
    """Documents as PDF files, some of them broken, by text blocks and by a layout model that takes the blocks as they are."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, "[^ -~]", "?"))
    files = fx.table(spark, d, "documents").select("doc_id", F.encode(F.when(F.col("doc_id") % 7 == 3, F.lit("no file of that kind")).otherwise(_pdf(lines)), "ISO-8859-1").alias("content"))
    found = [layout.extract(files, f).withColumn("engine", F.lit(name)) for name, f in (("blocks", layout.pdf_blocks), ("layout", layout.layout_blocks(lambda page, blocks: blocks)))]
    rows = found[0].unionByName(found[1])
    return rows.select("engine", "doc_id", "page_number", "elem_no", "text", "bbox", "confidence", "error")


@query(
    f"WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, '. ', '.' || chr(10) || chr(10)), '\\n{{2,}}'), lambda p: {_STRIP('p')}), lambda p: length(p) >= 2) AS ps, {_STRIP('text')} AS whole FROM documents), "
    "t AS (SELECT doc_id, CASE WHEN len(ps) > 0 THEN ps WHEN whole <> '' THEN [whole] ELSE [] END AS ps FROM s) SELECT doc_id, 1 AS page_number, CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS elem_no, unnest(ps) AS text, [0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE] AS bbox, 0.92::DOUBLE AS confidence FROM t"
)
def engine_scan(spark, d):
    """Documents as text files in UTF-8 and UTF-16, by the text engine."""
    shown = F.replace("text", F.lit(". "), F.lit(".\n\n"))
    files = fx.table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.encode(shown, "UTF-8")).otherwise(F.encode(shown, "UTF-16")).alias("content"))
    return layout.engine_elements(layout.engine_documents(files)).select("doc_id", "page_number", "elem_no", "text", "bbox", "confidence")


@query(f"SELECT conv_id AS doc_id, greatest(turn % 3, 1) AS page_number, string_agg({_STRIP('text')}, chr(10) ORDER BY turn) AS text FROM conversations WHERE {_STRIP('text')} <> '' GROUP BY ALL")
def pages_of_pieces(spark, d):
    return layout.pages_from_chunks(fx.table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), (F.col("turn") % 3).alias("page_number"), "text"))


_BLOCKS = "'<(/?(?:h[1-6]|p|li|ul|article|footer|body)\\b)'"


@query(
    f"WITH b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<script\\b.*?</script>', '', 'gis'), '<style\\b.*?</style>', '', 'gis'), '<!--.*?-->', '', 'gs') AS t FROM pages), "
    f"s AS (SELECT page_id, string_split(regexp_replace(t, {_BLOCKS}, chr(1) || '<\\1', 'gi'), chr(1)) AS parts FROM b), "
    "u AS (SELECT page_id, unnest(parts[:len(parts) - 1]) AS part, generate_subscripts(parts[:len(parts) - 1], 1) AS pos FROM s), "
    "m AS (SELECT page_id, pos, regexp_replace(part, '^<[^>]*>', '') AS raw FROM u WHERE regexp_matches(part, '^<(h[1-6]|p|li)(\\s[^>]*)?>', 'i')), "
    "n AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INTEGER) AS elem_no, regexp_replace(raw, '<[^>]*>', '', 'g') AS t FROM m), "
    f"r AS (SELECT page_id, elem_no, {_STRIP(chr(39).join(['replace(replace(replace(replace(replace(replace(t, ', '&lt;', ', ', '<', '), ', '&gt;', ', ', '>', '), ', '&quot;', ', ', chr(34), '), ', '&copy;', ', ', '©', '), ', '&middot;', ', ', '·', '), ', '&amp;', ', ', '&', ')'])) } AS text FROM n) "
    "SELECT page_id AS doc_id, elem_no, text, 0.92::DOUBLE AS confidence FROM r WHERE length(text) >= 3"
)
def html_elements(spark, d):
    return layout.html_elements(fx.table(spark, d, "pages")).select("doc_id", "elem_no", "text", "confidence")


@query(f"WITH {fx.LINES} SELECT DISTINCT doc_id, page_number, '/images/' || doc_id || '/page_' || lpad(CAST(page_number AS VARCHAR), 4, '0') || '.png' AS image_path, true AS is_png FROM lines")
def page_images(spark, d):
    pages = layout.with_images(layout.as_pages(fx.lines(spark, d)), "/images")
    return image.drawn(pages, dpi=18).select("doc_id", "page_number", "image_path", (F.hex(F.substring("png", 1, 8)) == "89504E470D0A1A0A").alias("is_png"))


@query(
    f"WITH {fx.LINES}, c AS (SELECT doc_id, page_number, o AS ord, round_even(avg(least(1.0::DOUBLE, confidence + (doc_id * 7 + page_number * 3 + o * 5) % 11 * 0.01::DOUBLE)), 4) AS conf FROM lines, (SELECT unnest([0, 1, 2]) AS o) GROUP BY ALL), "
    "b AS (SELECT *, max(conf) OVER (PARTITION BY doc_id, page_number ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c), "
    "r AS (SELECT * FROM b WHERE before IS NULL OR before < 0.9 QUALIFY row_number() OVER (PARTITION BY doc_id, page_number ORDER BY conf DESC, ord) = 1) "
    "SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE ord > 0) AS fallbacks, round(100.0::DOUBLE * count(*) FILTER (WHERE ord > 0) / count(*), 6) AS fallback_pct, count(*) FILTER (WHERE ord = 2) AS unboxed, list_sort(list(DISTINCT 'engine' || ord)) AS extractors FROM r GROUP BY 1"
)
def routing_report(spark, d):
    pages = []
    for o in range(3):
        rows = fx.lines(spark, d).withColumn("confidence", F.least(F.lit(1.0), F.col("confidence") + (F.col("doc_id") * 7 + F.col("page_number") * 3 + o * 5) % 11 * 0.01))
        rows = rows.withColumn("bbox", F.array(*[F.lit(0.0)] * 4)) if o == 2 else rows
        pages.append(layout.as_pages(rows).withColumn("ord", F.lit(o)).withColumn("extractor", F.lit(f"engine{o}")))
    return layout.routing_report(layout.route(pages[0].unionByName(pages[1]).unionByName(pages[2]), 0.9)).withColumn("fallback_pct", Q6(F.col("fallback_pct")))


@query(f"WITH {fx.LINES} SELECT doc_id, elem_no, elem_no % 9 <> 2 AND elem_no % 8 <> 3 AS good FROM lines")
def checked_elements(spark, d):
    i = F.col("elem_no")
    rows = fx.lines(spark, d).withColumn("bbox", F.when(i % 9 == 2, F.slice("bbox", 1, 3)).otherwise(F.col("bbox"))).withColumn("confidence", F.when(i % 8 == 3, F.lit(1.5)).otherwise(F.col("confidence")))
    good, bad = layout.checked(rows)
    return good.select("doc_id", "elem_no", F.lit(True).alias("good")).unionByName(bad.select("doc_id", "elem_no", F.lit(False).alias("good")))


# Chunks


def _headed(spark, d):
    i = F.col("elem_no")
    shown = F.when(i % 6 == 2, F.concat((1 + i % 30).cast("string"), F.lit(" Abschnitt der Reihe"))).when(i % 9 == 4, F.concat(F.col("text"), F.lit(" Ende. 3.1 Fristen gelten hier "), F.col("text"))).otherwise(F.col("text"))
    return fx.lines(spark, d).withColumn("text", shown)


_W = "[\\p{L}\\p{M}\\p{N}_]"
_NOISY = " OR ".join(["{0} = ''", *(f"regexp_matches({{0}}, '{p}')" for p in ("(?i)EVB-IT\\s+Dienst", "(?i)^Seite\\s+\\d+\\s+von\\s+\\d+", "(?i)Version\\s+\\d+\\.\\d+\\s+vom", "(?i)Die mit \\* gekennzeichneten", "^\\s*_+\\s*$", "\\.{{5,}}", "^\\d{{1,2}}\\s+von\\s+\\d{{1,2}}$"))])
_PARTS = f"""{fx.LINES}, headed AS (
  SELECT * REPLACE (CASE WHEN elem_no % 6 = 2 THEN (1 + elem_no % 30) || ' Abschnitt der Reihe' WHEN elem_no % 9 = 4 THEN text || ' Ende. 3.1 Fristen gelten hier ' || text ELSE text END AS text) FROM lines),
stripped AS (SELECT *, {_STRIP('text')} AS st FROM headed),
quiet AS (SELECT * FROM stripped WHERE NOT ({_NOISY.format('st')})),
cut AS (SELECT *, CASE WHEN type = 'table' THEN [struct_pack(text := text, kind := 'table')]
  WHEN regexp_matches(st, '^(§\\s*)?\\d{{1,2}}(\\.\\d)?\\s+[A-ZÄÖÜ][\\p{{L}}\\p{{M}}\\p{{N}}_äöüÄÖÜ\\s\\-,]{{3,60}}$') THEN [struct_pack(text := text, kind := 'heading')]
  ELSE list_filter(list_transform(string_split(regexp_replace(text, '([.!?\\s])(?:§\\s*)?(\\d{{1,2}}(?:\\.\\d)?)\\s+([A-ZÄÖÜ][\\p{{L}}\\p{{M}}\\p{{N}}_\\s\\-,]{{3,60}}?)\\s+({_W})', '\\1' || chr(1) || 'H\\2 \\3' || chr(1) || '\\4', 'g'), chr(1)),
    lambda x, i: struct_pack(text := {_STRIP("CASE WHEN i % 2 = 0 THEN substr(x, 2) ELSE x END")}, kind := CASE WHEN i % 2 = 0 THEN 'heading' ELSE 'body' END)), lambda p: p.text <> '') END AS ps FROM quiet),
one AS (SELECT *, CASE WHEN ps[1].kind IN ('table', 'heading') AND len(ps) = 1 AND (type = 'table' OR ps[1].text = text) THEN ps WHEN len(ps) > 1 THEN ps ELSE [struct_pack(text := st, kind := 'body')] END AS qs FROM cut),
parts AS (SELECT doc_id, page_number, elem_no, CAST(part_no - 1 AS INTEGER) AS part_no, p.kind AS kind, p.text AS text, bbox, confidence
  FROM (SELECT doc_id, page_number, elem_no, bbox, confidence, unnest(qs) AS p, generate_subscripts(qs, 1) AS part_no FROM one))"""


@query(f"WITH {_PARTS} SELECT doc_id, page_number, elem_no, part_no, kind, text FROM parts")
def inline_section_split(spark, d):
    return chunking.parts(_headed(spark, d)).select("doc_id", "page_number", "elem_no", "part_no", "kind", "text")


_BASE = f"""{_PARTS}, placed AS (
  SELECT *, sum(CASE WHEN kind <> 'body' THEN 1 ELSE 0 END) OVER w AS island, row_number() OVER w AS seq FROM parts WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY elem_no, part_no)),
bodies AS (SELECT *, length(text) AS n, row_number() OVER (PARTITION BY doc_id, page_number, island ORDER BY seq) AS k FROM placed WHERE kind = 'body'),
packed(doc_id, page_number, island, k, size, grp) AS (
  SELECT doc_id, page_number, island, k, n, 0 FROM bodies WHERE k = 1
  UNION ALL SELECT b.doc_id, b.page_number, b.island, b.k, CASE WHEN size > 0 AND size + n > 800 THEN n ELSE size + n END, grp + CASE WHEN size > 0 AND size + n > 800 THEN 1 ELSE 0 END
  FROM packed p JOIN bodies b ON b.doc_id = p.doc_id AND b.page_number = p.page_number AND b.island = p.island AND b.k = p.k + 1),
groups AS (
  SELECT doc_id, page_number, island, grp, min(seq) AS seq, string_agg(text, ' ' ORDER BY seq) AS body, list(bbox ORDER BY seq) AS boxes, min(confidence) AS confidence
  FROM bodies JOIN packed USING (doc_id, page_number, island, k) GROUP BY ALL),
heads AS (SELECT * FROM placed WHERE kind = 'heading'),
base AS (
  SELECT doc_id, page_number, seq, text, [bbox] AS bboxes, 'table' AS chunk_type, confidence FROM placed WHERE kind = 'table'
  UNION ALL SELECT h.doc_id, h.page_number, h.seq, h.text, [h.bbox], 'text', 0.9::DOUBLE FROM heads h ANTI JOIN groups g ON g.doc_id = h.doc_id AND g.page_number = h.page_number AND g.island = h.island
  UNION ALL SELECT g.doc_id, g.page_number, g.seq, CASE WHEN h.text IS NULL THEN body ELSE h.text || chr(10) || body END, CASE WHEN h.text IS NOT NULL AND grp = 0 THEN list_prepend(h.bbox, boxes) ELSE boxes END, 'text',
    CASE WHEN h.text IS NOT NULL AND grp = 0 THEN least(h.confidence, g.confidence) ELSE g.confidence END
  FROM groups g LEFT JOIN heads h ON g.doc_id = h.doc_id AND g.page_number = h.page_number AND g.island = h.island),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, seq) - 1 AS ord FROM base),
after AS (SELECT *, lead(text) OVER w AS t2, lead(bboxes) OVER w AS b2, lead(chunk_type) OVER w AS y2, lead(confidence) OVER w AS c2 FROM numbered WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
joined AS (SELECT *, {_STRIP("substr(text, greatest(length(text) - 199, 1))")} AS tail, {_STRIP("substr(t2, 1, 200)")} AS head FROM after WHERE t2 IS NOT NULL AND chunk_type <> 'table' AND y2 <> 'table'),
every AS (
  SELECT doc_id, page_number, 2 * ord AS ord, text, bboxes, chunk_type, confidence FROM numbered
  UNION ALL SELECT doc_id, page_number, 2 * ord + 1, tail || ' ' || head, [[list_min(list_transform(bboxes || b2, lambda b: b[1])), list_min(list_transform(bboxes || b2, lambda b: b[2])), list_max(list_transform(bboxes || b2, lambda b: b[3])), list_max(list_transform(bboxes || b2, lambda b: b[4]))]],
    'overlap', least(confidence, c2) FROM joined WHERE tail <> '' AND head <> '' AND length(tail || ' ' || head) >= 40),
long AS (SELECT *, {_STRIP("text")} AS st2 FROM every),
firsts AS (SELECT * FROM long WHERE length(st2) >= 40 AND NOT ({_NOISY.format("st2")}) QUALIFY row_number() OVER (PARTITION BY doc_id, regexp_replace(substr(lower(st2), 1, 200), '\\s+', ' ', 'g') ORDER BY ord) = 1)
SELECT doc_id, page_number, text, bboxes, chunk_type, confidence, '' AS image_path, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS INTEGER) AS chunk_id FROM firsts"""


@query(f"WITH RECURSIVE {_BASE}")
def chunk_layout(spark, d):
    return chunking.chunk(_headed(spark, d))


@query(
    f"WITH {fx.LINES}, t AS (SELECT doc_id, elem_no, CASE WHEN elem_no % 4 = 0 THEN (elem_no % 120) || ' Titel ' || substr(text, 1, 50) ELSE text END AS t FROM lines) "
    f"SELECT doc_id, elem_no, regexp_matches({_STRIP('t')}, '^(§\\s*)?\\d{{1,2}}(\\.\\d)?\\s+[A-ZÄÖÜ][\\p{{L}}\\p{{M}}\\p{{N}}_äöüÄÖÜ\\s\\-,]{{3,60}}$') AS heading FROM t"
)
def heading_filter(spark, d):
    i = F.col("elem_no")
    shown = F.when(i % 4 == 0, F.concat((i % 120).cast("string"), F.lit(" Titel "), F.left("text", F.lit(50)))).otherwise(F.col("text"))
    return fx.lines(spark, d).select("doc_id", "elem_no", text.is_heading(shown).alias("heading"))


_VECTOR = """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\\s\\x0b]+'), lambda t: t <> '') AS ts FROM documents),
h AS (SELECT doc_id, CAST('0x' || substr(md5(t), 1, 2) AS INTEGER) % 64 AS i, CASE WHEN CAST('0x' || substr(md5(t), 3, 2) AS INTEGER) % 2 = 1 THEN 1 ELSE -1 END AS s FROM (SELECT doc_id, unnest(ts) AS t FROM w)),
v AS (SELECT doc_id, i, CAST(sum(s) AS DOUBLE) AS x FROM h GROUP BY ALL), n AS (SELECT doc_id, sqrt(sum(x * x)) AS n FROM v GROUP BY 1)
SELECT d.doc_id, list_transform(range(64), lambda k: round(CAST(CAST(coalesce(m[k] / nullif(n, 0), 0) AS FLOAT) AS DOUBLE), 6)) AS embedding FROM documents d LEFT JOIN (SELECT doc_id, map_from_entries(list((i, x))) AS m FROM v GROUP BY 1) USING (doc_id) LEFT JOIN n USING (doc_id)"""


@query(_VECTOR)
def embed_stub(spark, d):
    made = store.embed(fx.table(spark, d, "documents").select("doc_id", "text"))
    return made.select("doc_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 6) + F.lit(0.0)).alias("embedding"))


def _no_model(texts):
    raise OSError("no model")


@query("SELECT doc_id, [CAST(length('passage: ' || text) AS DOUBLE), 1.0::DOUBLE] AS embedding FROM documents")
def embed_fallback(spark, d):
    """Vectors of the fallback where the model can't be reached."""
    made = store.embed(fx.table(spark, d, "documents").select("doc_id", "text"), "multilingual-e5", _no_model, lambda texts: [[float(len(t)), 1.0] for t in texts])
    return made.select("doc_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))


# The store and the graph


@query(
    "SELECT doc_id, 0 AS chunk_id, lang || '!' AS text, n_chars FROM documents WHERE doc_id % 10 = 0 AND doc_id % 20 <> 0 UNION ALL "
    "SELECT doc_id, k, lang, n_chars FROM documents, (SELECT unnest([0, 1]) AS k) WHERE doc_id % 10 <> 0"
)
def store_roundtrip(spark, d):
    """Two chunks a document; then every tenth is indexed anew and half of those have no chunk any more. Read back from the table."""
    docs = fx.table(spark, d, "documents").select("doc_id", F.col("lang").alias("text"), "n_chars")
    path = fx.folder(spark)
    store.upsert(spark, path, docs.withColumn("chunk_id", F.explode(F.array(F.lit(0), F.lit(1)))), 8)
    again = docs.filter("doc_id % 10 = 0")
    store.upsert(spark, path, again.filter("doc_id % 20 <> 0").select("doc_id", F.concat("text", F.lit("!")).alias("text"), "n_chars", F.lit(0).alias("chunk_id")), 8, again)
    return store.load(spark, path).select("doc_id", "chunk_id", "text", "n_chars")


@query(f"WITH {fx.SECTIONED}, n AS ({_NODES}), e AS ({_EDGES}) SELECT doc_id, id, node_type AS kind, coalesce(label, '') AS target FROM n UNION ALL SELECT doc_id, src, edge_type, dst FROM e")
def graph_roundtrip(spark, d):
    chunks, path = fx.sectioned(spark, d), fx.folder(spark)
    graph.save(graph.nodes(chunks), graph.edges(chunks), path)
    nodes, edges = graph.load(spark, path)
    return nodes.select("doc_id", "id", F.col("node_type").alias("kind"), F.coalesce("label", F.lit("")).alias("target")).unionByName(edges.select("doc_id", F.col("src").alias("id"), F.col("edge_type").alias("kind"), F.col("dst").alias("target")))


@query(f"WITH {fx.SECTIONED}, last AS (SELECT doc_id, text, max(chunk_id) AS chunk_id FROM chunks GROUP BY ALL), s AS (SELECT doc_id AS query_id, chunk_id AS rank, doc_id, text FROM chunks WHERE chunk_id % 5 = 0 AND doc_id % 2 = 0) SELECT query_id, rank, doc_id, last.chunk_id FROM s JOIN last USING (doc_id, text)")
def seeds_of_texts(spark, d):
    chunks = fx.sectioned(spark, d)
    seeds = chunks.filter("chunk_id % 5 = 0").select(F.col("doc_id").alias("query_id"), F.col("chunk_id").alias("rank"), "doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise("no such text").alias("text"))
    return graph.seeds_by_text(seeds, chunks)


@query(f"WITH {fx.SECTIONED} SELECT doc_id AS query_id, doc_id, chunk_id, CAST(chunk_id // 11 + 1 AS INTEGER) AS rank FROM chunks WHERE chunk_id % 11 = 4")
def expand_without_graph(spark, d):
    """Hits stay as they are where there is no graph."""
    chunks = fx.sectioned(spark, d)
    hits = chunks.filter("chunk_id % 11 = 4").select(F.col("doc_id").alias("query_id"), "doc_id", "chunk_id", (F.floor(F.col("chunk_id") / 11) + 1).cast("int").alias("rank"))
    return lifecycle.expanded(lifecycle.Index(chunks.withColumn("embedding", F.lit(None)), chunks, None, None), hits).select("query_id", "doc_id", "chunk_id", "rank")


@query("SELECT count(*) AS hits FROM documents WHERE contains(text, 'token') OR contains(text, 'License')")
def chunk_dump(spark, d):
    path = fx.folder(spark)
    n = sessions.dump(fx.table(spark, d, "documents").select("doc_id", "text"), path, ["token", "License"])
    return spark.read.schema("doc_id bigint, text string").json(path).filter(text.contains_any(F.col("text"), ["token", "License"])).agg(F.count("*").alias("hits")).filter(F.col("hits") == n)


# Types, threads and models


@query("SELECT * FROM (VALUES ('a', 0, 'd', ['eins', 'one']), ('b', 1, 'e', ['zwei'])) t(doc_type, hints, domain, keywords)")
def taxonomy_scan(spark, d):
    path = fx.folder(spark)
    specs = [{"doc_type": "b", "detection_hints": ["x"], "domains": {"e": {"keywords_de": ["zwei"]}}}, {"doc_type": "a", "domains": {"d": {"keywords_de": ["eins"], "keywords_en": ["one"]}}}]
    for k, spec in enumerate(specs):
        spark.createDataFrame([(json.dumps(spec),)], "value string").coalesce(1).write.text(f"{path}/{k}")
    hints, domains = answering.read_taxonomy(spark, f"{path}/*", "*.txt")
    rows = [(t, len(hints.get(t, [])), name, words) for t, own in domains.items() for name, words in own.items()]
    return spark.createDataFrame(rows, "doc_type string, hints int, domain string, keywords array<string>")


@query(f"WITH {_SAMPLE} SELECT doc_id, CASE WHEN b.s >= 8 THEN name WHEN doc_id % 3 = 0 THEN 'fr' ELSE 'fallback' END AS doc_type, b.s AS score FROM ({_best_sql('smp', 'text', WORDS, 8, 'fallback')})")
def classify_with_reply(spark, d):
    """Documents below the hits that decide are typed by a model's reply."""
    chunks = fx.lines(spark, d).withColumn("chunk_id", F.col("elem_no"))
    return answering.classify(chunks, WORDS, F.when(F.col("doc_id") % 3 == 0, F.lit("This is FR, I think.")).otherwise(F.lit("none of them")), least=8)


@query(f"WITH w AS (SELECT conv_id, turn, turn + 1 AS page, [[CAST(turn AS DOUBLE), 2.0::DOUBLE, 3.0::DOUBLE, 4.0::DOUBLE]] AS bboxes, 'p' || turn || '.png' AS image FROM conversations) SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS pos, CAST(page AS INTEGER) AS page, bboxes, image FROM w QUALIFY pos <= 5")
def cited_sources(spark, d):
    twice = fx.table(spark, d, "conversations").withColumn("text", F.concat(_wrapped(), F.lit("\n"), _wrapped()))
    return answering.cited(twice)


@query("SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT c.conv_id, m + 1 + k, 'user', 'more ' || k FROM (SELECT conv_id, max(turn) AS m FROM conversations GROUP BY 1) c, (SELECT unnest([0, 1]) AS k)")
def thread_append(spark, d):
    log = fx.table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    new = log.select("conv_id").distinct().select("conv_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("ord")).select("conv_id", "ord", F.lit("user").alias("role"), F.concat(F.lit("more "), F.col("ord").cast("string")).alias("text"))
    return answering.appended(log, new)


@query(
    f"WITH m AS (SELECT conv_id, turn, text, {_STRIP("text || chr(10) || '],'")} AS a, {_STRIP(chr(39) + ' x ' + chr(39) + ' || text')} AS b FROM conversations), p AS (SELECT conv_id, turn * 2 AS k, a AS s FROM m UNION ALL SELECT conv_id, turn * 2 + 1, b FROM m), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS r FROM p WHERE s <> '') SELECT conv_id, string_agg(s, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY r) AS context FROM n WHERE r <= 5 GROUP BY 1"
)
def context_fallback(spark, d):
    """The first five sections of a thread where none fits the budget; a source note ends at its first bracket."""
    return answering.context(fx.table(spark, d, "conversations").select("conv_id", "turn", F.lit("tool").alias("role"), _wrapped().alias("text")), 0)


_GERMAN = "regexp_matches(lower({0}), '(^|[^\\p{{L}}\\p{{N}}_])(" + "|".join(text.GERMAN) + ")($|[^\\p{{L}}\\p{{N}}_])')"


@query(
    f"SELECT conv_id, turn, CASE WHEN {_GERMAN.format('text')} THEN 'Beantworte die Frage nur mit dem Kontext und nenne die Seiten.' || chr(10) || chr(10) || 'Kontext:' || chr(10) || role || chr(10) || chr(10) || 'Frage: ' || text || chr(10) || chr(10) || 'Antwort:' "
    "ELSE 'Answer the question from the context alone and name the pages.' || chr(10) || chr(10) || 'Context:' || chr(10) || role || chr(10) || chr(10) || 'Question: ' || text || chr(10) || chr(10) || 'Answer:' END AS prompt FROM conversations"
)
def answer_prompts(spark, d):
    return fx.table(spark, d, "conversations").select("conv_id", "turn", text.answer_prompt(F.col("text"), F.col("role")).alias("prompt"))


@query("SELECT CAST(conv_id AS VARCHAR) AS conv_id, 'after ' || least(conv_id % 6, 3) || ': ' || max(text) AS answer FROM conversations WHERE turn = 0 GROUP BY conv_id")
def converse_loop(spark, d):
    """Threads that call a tool as often as their id says, up to the calls that are allowed; the last message is the answer."""
    first = fx.table(spark, d, "conversations").filter("turn = 0").groupBy(F.col("conv_id").cast("string").alias("conv_id")).agg(F.max("text").alias("text"))

    def model(log):
        said = log.groupBy("conv_id").agg(F.count_if(F.col("role") == "tool").alias("n"), F.max(F.when(F.col("role") == "user", F.col("text"))).alias("q"))
        want = F.col("n") < F.col("conv_id").cast("bigint") % 6
        return said.select("conv_id", F.concat(F.lit("after "), F.col("n").cast("string"), F.lit(": "), "q").alias("text"), want.cast("int").alias("tool_calls"))

    return sessions.converse(sessions.Threads(spark), first, model, lambda calls: calls)


@query("SELECT doc_id, CASE source WHEN 'src0' THEN 'model-a' WHEN 'src1' THEN 'model-b' ELSE source END AS model, coalesce(CASE WHEN doc_id % 2 = 0 THEN source END, 'new') AS thread FROM documents")
def model_and_thread_ids(spark, d):
    given = F.when(F.col("doc_id") % 2 == 0, F.col("source"))
    made = sessions.thread_id(given)
    docs = fx.table(spark, d, "documents").select("doc_id", sessions.model_ids(F.col("source"), {"src0": "model-a", "src1": "model-b"}).alias("model"), "source", made.alias("t"))
    return docs.select("doc_id", "model", F.when(F.length("t") == 36, "new").otherwise(F.col("t")).alias("thread"))


@query("SELECT doc_id, (lang = 'de' AND doc_id % 2 = 0) AS thinking FROM documents")
def thinking_models(spark, d):
    name = F.concat(F.when(F.col("lang") == "de", "Qwen3:4b").otherwise("small:4b"), F.when(F.col("doc_id") % 2 == 0, "").otherwise("-instruct"))
    return fx.table(spark, d, "documents").select("doc_id", answering.thinks(name).alias("thinking"))


@query(
    "WITH w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_À-ɏ]+') AS ts FROM documents), q AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_À-ɏ]+') AS qs FROM benchmark WHERE item_id % 5 = 0), "
    "t AS (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM w), tf AS (SELECT doc_id, dl, term, count(*) AS f FROM t GROUP BY ALL), df AS (SELECT term, count(*) AS d FROM tf GROUP BY 1), z AS (SELECT count(*) AS n, avg(CAST(len(ts) AS DOUBLE)) AS a FROM w), "
    "i AS (SELECT term, ln(n - d + 0.5::DOUBLE) - ln(d + 0.5::DOUBLE) AS raw FROM df, z), e AS (SELECT avg(raw) AS m FROM i), x AS (SELECT query_id, term, count(*) AS k FROM (SELECT query_id, unnest(qs) AS term FROM q) GROUP BY ALL), "
    "s AS (SELECT query_id, doc_id, sum(k * CASE WHEN raw < 0 THEN 0.25::DOUBLE * m ELSE raw END * f * 2.5::DOUBLE / (f + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / a))) AS score FROM tf JOIN i USING (term) JOIN x USING (term), e, z GROUP BY ALL) "
    "SELECT query_id, doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10"
)
def bm25_indexed(spark, d):
    """A batch of questions against written postings."""
    path = fx.folder(spark)
    retrieval.write_postings(retrieval.postings(fx.table(spark, d, "documents")), path, 16)
    asked = fx.questions(spark, d).filter("query_id % 5 = 0")
    scored = retrieval.bm25_asked(retrieval.read_postings(spark, path), asked, parts=16)
    return retrieval.best(scored, 10).select("query_id", "doc_id", Q6(F.col("score")).alias("score"), "rank")
