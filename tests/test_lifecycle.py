"""From elements to cited answers."""

import pytest
from pyspark.sql import functions as F

from tesserae.operators import retrieval
from tesserae.plans import fixtures, lifecycle

BOX = [0.0, 0.0, 100.0, 20.0]
ROWS = [
    (1, "text", "§ 10 Vertragsstrafe"),
    (1, "text", "Bei Verzug des Lieferanten ist eine Vertragsstrafe von fünf Prozent der Summe zu zahlen, siehe §11."),
    (2, "text", "§ 11 Fristen der Leistung"),
    (2, "text", "Die Frist beträgt vierzehn Tage ab Zugang der Bestellung beim Lieferanten, sofern nichts anderes vereinbart ist."),
    (3, "table", "| Leistung | Preis in Euro |\n| --- | --- |\n| Wartung der Anlage | 500 |"),
    (3, "text", "Alle Preise verstehen sich ohne die Umsatzsteuer, die der Auftraggeber zusätzlich zu tragen hat."),
]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rows = [(d, p, k, kind, t, BOX, 0.9, f"page_{p}.png") for d in (1, 2) for k, (p, kind, t) in enumerate(ROWS)]
    elements = spark.createDataFrame(rows, "doc_id int, page_number int, elem_no int, type string, text string, bbox array<double>, confidence double, image_path string")
    path = str(tmp_path_factory.mktemp("index"))
    lifecycle.write(lifecycle.index(elements), path)
    return lifecycle.load(spark, path)


def questions(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")


def test_tables(made):
    kinds = {r.chunk_type for r in made.chunks.collect()}
    assert kinds == {"text", "overlap", "table"} and made.types.count() == 2 and made.nodes.count() > made.chunks.count() and made.edges.count() > 0


def test_retrieve(spark, made):
    asked = lifecycle.asked(questions(spark, "Wie lange ist die Frist?", "Preis der Wartung"))
    hits = lifecycle.retrieve(made, asked, 3).collect()
    assert {r.query_id for r in hits} == {0, 1} and all(1 <= r["rank"] <= 3 for r in hits)
    one = lifecycle.retrieve(made, asked, 3, where=F.col("doc_id") == 2).collect()
    assert {r.doc_id for r in one} == {2}
    again = lifecycle.retrieve(made, asked, 3, rerank=retrieval.overlap_score).collect()
    assert len(again) == len(hits)


def test_tools(spark, made):
    asked = lifecycle.asked(questions(spark, "Preis Wartung Anlage Euro", "Frist Zugang Bestellung"))
    found = {r.query_id: r.content for r in lifecycle.search_term(made, asked).collect()}
    assert all(c.startswith("FOUND SECTIONS (") and "[source: page" in c for c in found.values())
    tables = {r.query_id: r.content for r in lifecycle.extract_table(made, asked).collect()}
    assert tables[0].startswith("Leistung,Preis in Euro\r\n") or tables[0].startswith("Leistung")
    assert all(r.bboxes for r in lifecycle.summarise_section(made, asked).collect())
    assert {r.query_id for r in lifecycle.highlight_section(made, asked, F.lit(2)).collect()} == {0, 1}
    kept = lifecycle.search_term(made, asked, F.lit('{"relevant": false, "score": 0}'), gate=2.0)
    assert {r.content for r in kept.collect()} == {retrieval.NO_RESULTS}


def test_ask(spark, made):
    rows = {r.query_id: r for r in lifecycle.ask(made, questions(spark, "Wie lange ist die Frist?", "What is the price?")).collect()}
    assert "Frage: Wie lange" in rows[0].prompt and "Question: What is" in rows[1].prompt
    assert rows[0].sources and len({s.page for s in rows[0].sources}) == len(rows[0].sources) <= 5
    assert "[source:" not in rows[0].answer
    replied = lifecycle.ask(made, questions(spark, "Wie?"), lambda prompt: F.concat(F.lit("<think>x</think> "), F.upper(F.left(prompt, F.lit(9))))).first()
    assert replied.answer == "BEANTWORT"


def test_empty_index(spark, made):
    empty = lifecycle.Index(*(df.limit(0) for df in (made.chunks, made.types, made.nodes, made.edges)))
    asked = lifecycle.asked(questions(spark, "x"))
    assert {r.content for r in lifecycle.search_term(empty, asked).collect()} == {retrieval.NO_RESULTS}
    assert {r.content for r in lifecycle.extract_table(empty, asked).collect()} == {retrieval.NO_TABLE}


def test_fixture_lines(spark):
    rows = fixtures.lines(spark, "/root/testdata/sf0.001")
    assert rows.filter("page_number <> 1 + floor(elem_no / 10)").count() == 0
