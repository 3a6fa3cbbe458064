"""Text and box functions on small cases."""

import pytest
from pyspark.sql import functions as F

from tesserae.functions import geometry, text


def one(spark, column, **values):
    cols = [F.lit(v).alias(k) if not isinstance(v, list) else F.from_json(F.lit(repr(v).replace("'", '"')), "array<array<double>>" if v and isinstance(v[0], list) else "array<double>").alias(k) for k, v in values.items()]
    return spark.range(1).select(*cols).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "value, noise",
    [("\t", True), ("\xa0 \n", True), ("Seite 41 von 77", True), ("auf Seite 41 von 77", False), ("die Version 7.3 vom Mai", True), (" ___ ", True), ("Inhalt ........ 9", True), ("8 von 9", True), ("108 von 9", False), ("evb-it dienst", True), ("ein Satz", False)],
)
def test_noise(spark, value, noise):
    assert one(spark, text.is_noise(F.col("t")), t=value) is noise


@pytest.mark.parametrize("value, heading", [("4 Lieferung", True), ("§ 8.2 Preise, Rabatte", True), ("8.2.6 Drei Stufen", False), ("4 klein", False), ("Ohne Nummer", False), ("123 Dreistellig", False)])
def test_heading(spark, value, heading):
    assert one(spark, text.is_heading(F.col("t")), t=value) is heading


@pytest.mark.parametrize("value, label", [("§6 Abnahme\nWortlaut", "6"), ("6.4 Preise", "6.4"), ("Zeile\n§ 5.9. Anderes", "5.9"), ("6 Preise", None), ("leer", None)])
def test_section_label(spark, value, label):
    assert one(spark, text.section_label(F.col("t")), t=value) == label


def test_references_levels_and_parents(spark):
    assert one(spark, text.references(F.col("t")), t="nach §2, §7.5 oder § 31") == ["2", "7.5", "31"]
    assert one(spark, text.section_level(F.col("t")), t="4.7.9") == 3
    assert one(spark, text.parent_label(F.col("t")), t="4.7.9") == "4.7"
    assert one(spark, text.parent_label(F.col("t")), t="4") is None


def test_inline_parts(spark):
    from tesserae.operators.chunking import INLINE

    got = one(spark, text.inline_parts(F.col("t"), INLINE), t="Vorher steht etwas. 3.1 Fristen gelten hier und weiter")
    assert [(p.text, p.heading) for p in got][0] == ("Vorher steht etwas.", False)
    assert [p.heading for p in got] == [False, True, False]
    assert [(p.text, p.heading) for p in one(spark, text.inline_parts(F.col("t"), INLINE), t=" no heading ")] == [(" no heading ", False)]


def test_page_boost(spark):
    assert [round(one(spark, text.page_boost(F.col("p")), p=p), 6) for p in (-1, 1, 3)] == [1.0, 1.0, 0.5]


@pytest.mark.parametrize("value, lang", [("Wer haftet wofür?", "de"), ("Which page is it on?", "en"), ("LAUT GEMÄSS gemäß", "de"), ("bismarck", "en")])
def test_language(spark, value, lang):
    assert one(spark, text.detect_language(F.col("t")), t=value) == lang


def test_tool_output(spark):
    raw = "FOUND SECTIONS (2 total — read all):\n\n--- Abschnitt 1 ---\nOne\n[source: page 4, bboxes=[[0.0, 1.0, 2.0, 3.0]], image_path='a.png']\n\n--- Abschnitt 2 ---\nTwo\n[source: page 5, bboxes=[1.0, 2.0, 3.0, 4.0], image_path='']"
    assert len(one(spark, text.split_sections(F.col("t")), t=raw)) == 2
    assert one(spark, text.strip_metadata(F.col("t")), t="One\n[source: page 4, bboxes=[[1]], image_path='a.png']\n\n\n\nTwo").startswith("One")
    got = one(spark, text.parse_sources(F.col("t")), t=raw)
    assert [(s.page, s.bboxes, s.image) for s in got] == [(4, [[0.0, 1.0, 2.0, 3.0]], "a.png"), (5, [[1.0, 2.0, 3.0, 4.0]], "page_0005.png")]
    assert one(spark, text.parse_sources(F.col("t")), t="nothing") == []


@pytest.mark.parametrize(
    "reply, want",
    [
        ('{"relevant": false, "score": 0.9, "reason": "x"}', (False, 0.9, "x")),
        ('```json\n{"relevant": true, "score": 0.1}\n```', (True, 0.1, "")),
        ("{}", (True, 0.5, "")),
        ("not JSON", (True, 0.5, "parse error")),
        ("", (True, 0.5, "parse error")),
    ],
)
def test_relevance(spark, reply, want):
    assert tuple(one(spark, text.parse_relevance(F.col("t")), t=reply)) == want


def test_csv(spark):
    assert one(spark, text.table_to_csv(F.col("t")), t="| Ort | Zahl |\n| -- | -- |\n| Ulm | 7 |") == "Ort,Zahl\r\nUlm,7\r\n"
    assert one(spark, text.table_to_csv(F.col("t")), t='intro\n| a, b | "q" |') == '"a, b","""q"""\r\n'
    assert one(spark, text.table_to_csv(F.col("t")), t="no table") == "no table"


def test_think_and_keywords(spark):
    assert one(spark, text.strip_think(F.col("t")), t="<think>a\nb</think> Answer <think></think>") == "Answer"
    assert one(spark, text.keyword_hits(F.col("t"), F.array(F.lit("Frist"), F.lit("frist"), F.lit("x"))), t="Die FRIST") == 2
    assert one(spark, text.contains_any(F.col("t"), ["Frist"]), t="Die FRIST") is False


def test_union(spark):
    assert one(spark, geometry.union_boxes(F.col("a"), F.col("b")), a=[[4.0, 40.0, 44.0, 90.0]], b=[[24.0, 15.0, 99.0, 55.0]]) == [[4, 15, 99, 90]]
    assert one(spark, geometry.union_boxes(F.col("a"), F.col("b")), a=[[0.0, 0.0, 1.0, 1.0]], b=[[30.0, 10.0, 80.0, 40.0]]) == [[30, 10, 80, 40]]
    assert one(spark, geometry.union_boxes(F.col("a"), F.col("b")), a=[[0.0, 0.0, 1.0, 1.0]], b=[[5.0, 5.0, 6.0, 6.0]]) == [[0, 0, 1, 1]]
    assert one(spark, geometry.hull_of_placed(F.col("a")), a=[[0.0, 0.0, 0.0, 0.0], [1.0, 2.0, 3.0, 4.0]]) == [1, 2, 3, 4]
    assert one(spark, geometry.hull_of_placed(F.col("a")), a=[[0.0, 0.0, 0.0, 0.0]]) == [0, 0, 0, 0]


@pytest.mark.parametrize("a, b, want", [([0.0, 0.0, 10.0, 10.0], [0.0, 0.0, 10.0, 10.0], 1.0), ([0.0, 0.0, 1.0, 1.0], [5.0, 5.0, 6.0, 6.0], 0.0), ([0.0, 0.0, 10.0, 10.0], [5.0, 0.0, 15.0, 10.0], 1 / 3), ([0.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 0.0], 0.0)])
def test_iou(spark, a, b, want):
    assert one(spark, geometry.iou(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want)


def test_iou_of_close_boxes(spark):
    assert one(spark, geometry.iou(F.col("a"), F.col("b")), a=[10.0, 10.0, 210.0, 60.0], b=[13.0, 12.0, 213.0, 62.0]) >= 0.7


def test_vectors(spark):
    assert one(spark, geometry.cosine(F.col("a"), F.col("b")), a=[3.0, 4.0], b=[3.0, 4.0]) == pytest.approx(1.0)
    assert one(spark, geometry.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[3.0, 4.0]) == 0.0
    assert one(spark, geometry.unit(F.col("a")), a=[0.0, 0.0]) == [0.0, 0.0]
    assert one(spark, geometry.scaled(F.col("a")), a=[72.0, 36.0, 0.0, 1.0])[:2] == [150.0, 75.0]
