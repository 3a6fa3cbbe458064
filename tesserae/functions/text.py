"""Column functions over text: tokens, headings, labels, references, tool output, model replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that decide results.
TOKEN = r"[\p{L}\p{N}_À-ɏ]+"
NOISE = [
    r"(?iU)EVB-IT\s+Dienst",
    r"(?iU)^Seite\s+\d+\s+von\s+\d+",
    r"(?iU)Version\s+\d+\.\d+\s+vom",
    r"(?iU)Die mit \* gekennzeichneten",
    r"(?U)^\s*_+\s*$",
    r"\.{5,}",
    r"(?U)^\d{1,2}\s+von\s+\d{1,2}$",
]
HEADING = r"(?U)^(§\s*)?\d{1,2}(\.\d)?\s+[A-ZÄÖÜ][\wäöüÄÖÜ\s\-,]{3,60}$"
LABEL = r"(?mU)^(?:§\s*(\d+(?:\.\d+)*)|(\d+(?:\.\d+)+))\.?\s+\S"
REFERENCE = r"§\s*(\d+(?:\.\d+)*)"
GERMAN = "was wie wann wo wer welch warum bitte ist sind hat haben werden kann darf muss soll gilt steht ab bis nach vor unter gemäß vertrag auftragnehmer auftraggeber leistung vergütung kündigung frist zahlung".split()
NOTES = r"(?sd)\[source:.*?\]|bboxes=\[.*?\]|image_path=.*?(?=\n|$)"
HEADS = r"(?md)^FOUND SECTIONS.*$|^GEFUNDENE ABSCHNITTE.*$|^--- Abschnitt \d+ ---$"
SOURCE = r"""(?s)\[source: page (\d+), bboxes=(\[.*?\]), image_path=('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")"""

MARK = "\u0001"
WHITE = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(c: Column) -> Column:
    """c without Unicode white space at its ends."""
    return F.btrim(c, F.lit(WHITE))


def tokens(c: Column) -> Column:
    """Lower-case word tokens in order; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


def is_noise(c: Column) -> Column:
    """Blank text, page furniture, rules and dot leaders."""
    s = strip(c)
    return (s == "") | s.rlike("|".join(f"(?:{p})" for p in NOISE))


def is_heading(c: Column) -> Column:
    """Whether the whole text is a numbered heading."""
    return strip(c).rlike(HEADING)


def inline_parts(c: Column, pattern: str) -> Column:
    """array<struct<text, heading>>: the text cut at inline headings that pattern finds (group 1 number, group 2 title).

    Blank parts go; a text without a heading, or of one part, is one body part as it was.
    """
    def named(cut: Column) -> Column:
        return F.filter(F.transform(cut, lambda x, i: F.struct(strip(x).alias("text"), (i % 2 == 1).alias("heading"))), lambda p: p["text"] != "")

    whole = F.array(F.struct(c.alias("text"), F.lit(False).alias("heading")))
    return let(named(F.split(F.regexp_replace(c, pattern, f"{MARK}$1 $2{MARK}"), MARK)), lambda parts: F.when(F.size(parts) > 1, parts).otherwise(whole))


def dedupe_key(c: Column) -> Column:
    """Lower-cased first 200 characters with white space collapsed afterwards."""
    return F.regexp_replace(F.left(F.lower(strip(c)), F.lit(200)), r"(?U)\s+", " ")


def section_label(c: Column) -> Column:
    """The number of the first section heading in the text, null if there is none."""
    first = F.regexp_extract(c, LABEL, 1)
    return F.nullif(F.when(first != "", first).otherwise(F.regexp_extract(c, LABEL, 2)), F.lit(""))


def section_title(c: Column) -> Column:
    """The first line of the text, at most 120 characters."""
    return F.left(F.get(F.split(strip(c), "\n"), F.lit(0)), F.lit(120))


def references(c: Column) -> Column:
    """All section numbers that the text refers to with a section sign, in order."""
    return F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(1))


def section_level(label: Column) -> Column:
    return F.size(F.split(label, r"\."))


def parent_label(label: Column) -> Column:
    """The label without its last number, null at the top."""
    return F.nullif(F.regexp_replace(label, r"\.[^.]+$", ""), label)


def preview(c: Column) -> Column:
    return F.left(c, F.lit(80))


def page_boost(page: Column) -> Column:
    """1 on page 1, falling with the logarithm of the page number."""
    return F.lit(1.0) / F.log2(F.greatest(page, F.lit(1)) + F.lit(1))


def detect_language(c: Column) -> Column:
    """'de' if the text has a German function word, else 'en'."""
    return F.when(c.rlike(r"(?iU)\b(" + "|".join(GERMAN) + r")\b"), "de").otherwise("en")


def strip_think(c: Column) -> Column:
    """A reply without its thinking sections."""
    return strip(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))


def split_sections(c: Column) -> Column:
    """The sections of a tool's output, without blank ones and the head line."""
    parts = F.transform(F.split(c, r"--- Abschnitt \d+ ---"), lambda p: strip(p))
    return F.filter(parts, lambda p: (p != "") & ~p.rlike("^(FOUND SECTIONS|GEFUNDENE ABSCHNITTE)"))


def strip_metadata(c: Column) -> Column:
    """A section without its source, box and image notes; three line ends or more become two."""
    for pattern in (NOTES, HEADS):
        c = F.regexp_replace(c, pattern, "")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def keyword_hits(c: Column, keywords: Column) -> Column:
    """How many of an array of keywords the text contains, case aside; repeated keywords count again."""
    return F.size(F.filter(keywords, lambda k: F.contains(F.lower(c), F.lower(k))))


def contains_any(c: Column, keywords: list[str]) -> Column:
    """Whether the text has one of the keywords, case and all."""
    return F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(c, k))


def needs_prefix(model: str) -> bool:
    """Whether an embedding model's texts need 'query: ' and 'passage: ' before them."""
    return "e5" in model.lower()


def prefixed(c: Column, model: str, kind: str = "passage") -> Column:
    return F.concat(F.lit(f"{kind}: "), c) if needs_prefix(model) else c


def parse_relevance(reply: Column) -> Column:
    """struct<relevant, score, reason> of a model's JSON reply, in a code fence or not; what doesn't parse counts as relevant at 0.5."""
    fenced = lambda bare: F.when(F.startswith(bare, F.lit("```")), strip(F.array_join(F.filter(F.split(bare, "\n"), lambda x: ~F.startswith(x, F.lit("```"))), "\n"))).otherwise(bare)
    plain = fenced(strip(reply))
    parsed = F.from_json(F.nullif(plain, F.lit("")), "relevant boolean, score double, reason string, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})

    def judged(made: Column) -> Column:
        good = made.isNotNull() & made["_corrupt"].isNull()
        return F.struct(
            F.coalesce(F.when(good, made["relevant"]), F.lit(True)).alias("relevant"),
            F.coalesce(F.when(good, made["score"]), F.lit(0.5)).alias("score"),
            F.when(good, F.coalesce(made["reason"], F.lit(""))).otherwise("parse error").alias("reason"),
        )

    return let(parsed, judged)


def table_lines(c: Column) -> Column:
    """array<array<string>>: the cells of the lines of a Markdown table; none if there is no table line."""
    rows = F.filter(F.split(c, "\n"), lambda x: F.startswith(strip(x), F.lit("|")) & ~strip(x).rlike(r"^[|\- ]*$"))
    inner = F.transform(rows, lambda x: F.regexp_replace(strip(x), r"^\|+|\|+$", ""))
    return F.transform(inner, lambda x: F.transform(F.split(x, r"\|"), lambda y: strip(y)))


def table_to_csv(c: Column) -> Column:
    """A Markdown table as CSV with CRLF line ends; text without table lines as it was."""

    def cell(x: Column) -> Column:
        quoted = F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(x.rlike('[",\r\n]'), quoted).otherwise(x)

    rows = table_lines(c)
    lines = F.transform(rows, lambda r: F.when((F.size(r) == 1) & (F.get(r, F.lit(0)) == ""), F.lit('""')).otherwise(F.array_join(F.transform(r, cell), ",")))
    return F.when(F.size(rows) > 0, F.concat(F.array_join(lines, "\r\n"), F.lit("\r\n"))).otherwise(c)


def render_result(text: Column, page: Column, bboxes: Column, image: Column) -> Column:
    """A retrieved text with its source note."""
    listed = lambda items: F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    shown = listed(F.transform(bboxes, lambda b: listed(F.transform(b, lambda x: x.cast("string")))))
    return F.concat(text, F.lit("\n[source: page "), page.cast("string"), F.lit(", bboxes="), shown, F.lit(", image_path='"), image, F.lit("']"))


def render_sections(sections: Column) -> Column:
    """An array of texts as one numbered listing."""
    n = F.size(sections)
    body = F.transform(sections, lambda s, i: F.concat(F.lit("--- Abschnitt "), (i + 1).cast("string"), F.lit(" ---\n"), s))
    return F.concat(F.lit("FOUND SECTIONS ("), n.cast("string"), F.lit(" total — read all):\n\n"), F.array_join(body, "\n\n"))


def parse_sources(c: Column) -> Column:
    """array<struct<page, bboxes, image>>: the source notes in a text; one flat box counts as a list of one."""
    pages, boxes, images = (F.regexp_extract_all(c, F.lit(SOURCE), F.lit(k)) for k in (1, 2, 3))

    def one(i: Column) -> Column:
        raw = F.get(boxes, i)
        nested = F.from_json(raw, "array<array<double>>")
        flat = F.from_json(raw, "array<double>")
        page = F.get(pages, i).cast("int")
        image = F.substring(F.get(images, i), F.lit(2), F.length(F.get(images, i)) - 2)  # without its quotes
        return F.struct(
            page.alias("page"),
            F.when(raw.rlike(r"^\[\s*\["), nested).when(F.size(flat) > 0, F.array(flat)).otherwise(F.array().cast("array<array<double>>")).alias("bboxes"),
            F.when(image != "", image).otherwise(F.format_string("page_%04d.png", page)).alias("image"),
        )

    return F.when(F.size(pages) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.size(pages), F.lit(1)) - 1), one)).otherwise(
        F.array().cast("array<struct<page:int,bboxes:array<array<double>>,image:string>>")
    )


def answer_prompt(question: Column, context: Column) -> Column:
    """The prompt for an answer from context, in the question's language."""
    german = F.concat(F.lit("Beantworte die Frage nur mit dem Kontext und nenne die Seiten.\n\nKontext:\n"), context, F.lit("\n\nFrage: "), question, F.lit("\n\nAntwort:"))
    english = F.concat(F.lit("Answer the question from the context alone and name the pages.\n\nContext:\n"), context, F.lit("\n\nQuestion: "), question, F.lit("\n\nAnswer:"))
    return F.when(detect_language(question) == "de", german).otherwise(english)
