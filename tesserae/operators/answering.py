"""Document types, domain routing, context budgets, message logs and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text

CONTEXT_CHARS, MAX_TOOL_CALLS, MAX_SOURCES, SAMPLE_CHUNKS, LEAST_HITS = 12_000, 4, 5, 15, 3

# Hints of document types, and keywords of their domains (German, then English); hints and types in order.
HINTS = {
    "contract": "Vertrag Vereinbarung Klausel Paragraph Vertragspartei agreement clause party obligation liability".split(),
    "magazine": "Ausgabe Heft Redaktion Impressum Jahrgang Verlag editorial issue edition publisher magazine".split(),
    "research": "Abstract Introduction Methodology References Conclusion Figure abstract hypothesis experiment dataset results citation".split(),
    "technical": "Handbuch Spezifikation Anleitung Installation Konfiguration Wartung manual specification installation configuration maintenance API".split(),
}
DOMAINS = {
    "contract": {
        "deadlines": ["Frist", "Verzug", "Reaktionszeit", "Vertragsstrafe", "Verzögerung", "Termin", "deadline", "delay", "penalty", "response time", "overdue"],
        "termination": ["Kündigung", "Laufzeit", "Vertragsende", "Verlängerung", "Kündigungsfrist", "termination", "notice", "contract duration", "renewal", "expiry"],
        "payment": ["Vergütung", "Zahlung", "Preis", "Pauschale", "Aufwand", "Rechnung", "payment", "remuneration", "invoice", "fee", "price", "cost"],
        "liability": ["Haftung", "Gewährleistung", "Schaden", "Schadensersatz", "Mängel", "liability", "warranty", "damages", "defect", "indemnity"],
        "data_privacy": ["Datenschutz", "DSGVO", "personenbezogen", "Auftragsverarbeitung", "data protection", "GDPR", "personal data", "privacy"],
    },
    "magazine": {
        "market_data": ["Umsatz", "Markt", "Wachstum", "Absatz", "Preis", "Menge", "Prozent", "revenue", "market", "growth", "sales", "volume", "price", "percent"],
        "company_news": ["Unternehmen", "Umsatz", "Ergebnis", "CEO", "Investition", "Übernahme", "company", "revenue", "result", "acquisition", "investment", "CEO"],
        "products": ["Produkt", "Neuheit", "Innovation", "Sortiment", "Launch", "Marke", "product", "launch", "innovation", "brand", "new", "range"],
        "events": ["Messe", "ISM", "Aussteller", "Besucher", "Award", "Veranstaltung", "fair", "trade show", "exhibitor", "visitor", "award", "event"],
    },
    "research": {
        "methodology": ["Methode", "Experiment", "Datensatz", "Evaluation", "Baseline", "method", "experiment", "dataset", "evaluation", "baseline", "approach"],
        "results": ["Ergebnis", "Leistung", "Genauigkeit", "Verbesserung", "Vergleich", "result", "performance", "accuracy", "improvement", "comparison", "score"],
        "background": ["Hintergrund", "Stand der Technik", "verwandt", "Literatur", "background", "related work", "prior", "literature", "survey"],
    },
    "technical": {
        "specifications": ["Spezifikation", "Parameter", "Anforderung", "Schnittstelle", "Format", "specification", "parameter", "requirement", "interface", "format"],
        "installation": ["Installation", "Setup", "Einrichtung", "Schritt", "Voraussetzung", "install", "setup", "configure", "step", "prerequisite"],
        "troubleshooting": ["Fehler", "Problem", "Lösung", "Fehlerbehebung", "Ursache", "error", "problem", "solution", "troubleshoot", "cause", "fix"],
    },
}
FALLBACK_TYPE, FALLBACK_DOMAIN = "fallback", "general"


def read_taxonomy(spark: SparkSession, folder: str, names: str = "*.json") -> tuple[dict[str, list[str]], dict[str, dict[str, list[str]]]]:
    """Hints by type, and keywords by type and domain, of a folder of JSON files (doc_type, detection_hints, domains); types by name."""
    domain = "struct<keywords_de:array<string>,keywords_en:array<string>>"
    raw = spark.read.format("binaryFile").load(f"{folder}/{names}").select(F.from_json(F.col("content").cast("string"), f"struct<doc_type:string,detection_hints:array<string>,domains:map<string,{domain}>>").alias("j"))
    rows = sorted(raw.select("j.*").collect(), key=lambda r: r["doc_type"])  # a file each
    hints = {r["doc_type"]: list(r["detection_hints"] or ()) for r in rows if r["doc_type"] != FALLBACK_TYPE}
    return hints, {r["doc_type"]: {d: [*(x["keywords_de"] or ()), *(x["keywords_en"] or ())] for d, x in (r["domains"] or {}).items()} for r in rows}


def keyword_scores(rows: DataFrame, keywords: dict[str, list[str]], column: str = "text") -> DataFrame:
    """Rows with scores: for each name in order, how many of its keywords the column contains, case aside.

    The keywords are constants of the plan, so each row is read once and nothing is joined.
    """
    low = F.lower(F.coalesce(F.col(column), F.lit("")))
    hits = [F.struct(F.lit(k).alias("name"), sum((F.contains(low, F.lit(w.lower())).cast("int") for w in words), F.lit(0)).alias("score"), F.lit(-i).alias("ord")) for i, (k, words) in enumerate(keywords.items())]
    return rows.withColumn("scores", F.array(*hits))


def best_of(scores: Column, fallback: str, least: int) -> Column:
    """struct<name, score> of the greatest score, the first of equal ones; fallback at 0 below least."""
    top = F.array_max(F.transform(scores, lambda s: F.struct(s["score"].alias("score"), s["ord"].alias("ord"), s["name"].alias("name"))))
    return F.when(top["score"] >= least, F.struct(top["name"].alias("name"), top["score"].alias("score"))).otherwise(F.struct(F.lit(fallback).alias("name"), F.coalesce(top["score"], F.lit(0)).alias("score")))


def classify(chunks: DataFrame, hints: dict[str, list[str]] | None = None, reply: Column | None = None, least: int = LEAST_HITS) -> DataFrame:
    """(doc_id, doc_type, score): the type whose hints a document's first chunks have most of.

    Below least hits the type that a model's reply names, else the fallback.
    """
    hints = HINTS if hints is None else hints
    first = chunks.filter(F.col("chunk_id") < SAMPLE_CHUNKS)
    sample = first.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))).alias("_c")).select("doc_id", F.array_join(F.col("_c.text"), "\n").alias("text"))
    best = keyword_scores(sample, hints).withColumn("_b", best_of(F.col("scores"), FALLBACK_TYPE, least))
    kind = F.col("_b.name")
    if reply is not None:
        named = F.get(F.filter(F.array(*map(F.lit, hints)), lambda t: F.contains(F.lower(reply), t)), F.lit(0))
        kind = F.when(F.col("_b.score") >= least, kind).otherwise(F.coalesce(named, F.lit(FALLBACK_TYPE)))
    return best.select("doc_id", kind.alias("doc_type"), F.col("_b.score").alias("score"))


def route(queries: DataFrame, domains: dict[str, list[str]]) -> DataFrame:
    """Queries (query_id, query) with the domain whose keywords they have most of, the first of equal ones; general without any."""
    best = keyword_scores(queries, domains, "query").withColumn("_b", best_of(F.col("scores"), FALLBACK_DOMAIN, 1))
    return best.select("query_id", "query", F.col("_b.name").alias("domain"), F.col("_b.score").alias("score"))


def trim(snippets: Column, limit: int = CONTEXT_CHARS) -> Column:
    """The texts of an array that fit into limit characters, longest first, in their own order.

    The fold copies only the list of those that fit, which the limit bounds; texts that don't fit cost a comparison.
    """
    ranked = F.array_sort(F.transform(snippets, lambda s, i: F.struct((-F.length(s)).alias("size"), i.alias("i"), s.alias("s"))))
    start = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("kept"))

    def step(a: Column, x: Column) -> Column:
        fits = a["total"] - x["size"] <= limit
        return F.struct(F.when(fits, a["total"] - x["size"]).otherwise(a["total"]).alias("total"), F.when(fits, F.array_append(a["kept"], x["i"])).otherwise(a["kept"]).alias("kept"))

    kept = F.aggregate(ranked, start, step, lambda a: a["kept"])
    return F.transform(F.array_sort(kept), lambda i: F.get(snippets, i))


def context(messages: DataFrame, limit: int = CONTEXT_CHARS, role: str = "tool") -> DataFrame:
    """(conv_id, context): the sections of each thread's tool messages within the budget, without notes; the first five if none fits."""
    parts = messages.filter(F.col("role") == role).select("conv_id", "turn", F.posexplode(text.split_sections(F.col("text"))).alias("k", "s"))
    made = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "k", "s"))).alias("_p")).withColumn("_s", F.col("_p.s"))
    fitting = trim(F.col("_s"), limit)
    chosen = made.withColumn("_f", fitting).withColumn("_c", F.when(F.size("_f") > 0, F.col("_f")).otherwise(F.slice("_s", 1, 5)))
    return chosen.select("conv_id", F.array_join(F.transform("_c", lambda s: text.strip_metadata(s)), "\n\n---\n\n").alias("context"))


def last_questions(messages: DataFrame, role: str = "user") -> DataFrame:
    """(conv_id, question): each thread's last message of a role, without the mark that switches thinking off."""
    last = messages.filter(F.col("role") == role).groupBy("conv_id").agg(F.max_by("text", "turn").alias("t"))
    return last.select("conv_id", text.strip(F.replace("t", F.lit(" /nothink"), F.lit(""))).alias("question"))


def without_thinking(messages: DataFrame, role: str = "user") -> DataFrame:
    """The messages, each thread's last of a role marked to switch thinking off."""
    last = messages.filter(F.col("role") == role).groupBy("conv_id").agg(F.max("turn").alias("_last"))
    met = messages.join(last, "conv_id", "left")
    marked = (F.col("turn") == F.col("_last")) & (F.col("role") == role) & ~F.contains("text", F.lit("/nothink"))
    return met.withColumn("text", F.when(marked, F.concat("text", F.lit(" /nothink"))).otherwise(F.col("text"))).drop("_last")


def tool_calls(messages: DataFrame, role: str = "assistant") -> DataFrame:
    """(conv_id, calls, go_on): messages of a role that call tools (tool_calls above 0), and whether another call is allowed."""
    calls = F.count_if((F.col("role") == role) & (F.col("tool_calls") > 0))
    return messages.groupBy("conv_id").agg(calls.alias("calls")).withColumn("go_on", F.col("calls") < MAX_TOOL_CALLS)


def following(log: DataFrame, new: DataFrame) -> DataFrame:
    """New messages (conv_id, ord, role, text) as rows of a log (conv_id, turn, role, text), after each thread's last turn."""
    last = log.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    order = Window.partitionBy("conv_id").orderBy("ord")
    more = new.join(last, "conv_id", "left").withColumn("turn", F.coalesce("_last", F.lit(-1)) + F.row_number().over(order))
    return more.select(*log.columns)


def appended(log: DataFrame, new: DataFrame) -> DataFrame:
    """A message log with new messages after each thread's last turn."""
    return log.unionByName(following(log, new))


def cited(messages: DataFrame, most: int = MAX_SOURCES) -> DataFrame:
    """(conv_id, pos, page, bboxes, image): the sources noted in each thread's messages, the first of each page, most at most."""
    rows = messages.select("conv_id", "turn", F.posexplode(text.parse_sources(F.col("text"))).alias("k", "s"))
    first = Window.partitionBy("conv_id", "s.page").orderBy("turn", "k")
    rows = rows.withColumn("_k", F.row_number().over(first)).filter("_k = 1")
    order = Window.partitionBy("conv_id").orderBy("turn", "k")
    return rows.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= most).select("conv_id", "pos", "s.page", "s.bboxes", "s.image")


# Names of chat models that think aloud, and endings of those that don't.
THINKING, PLAIN = ("qwen3", "qwen2.5", "deepseek-r", "phi4-reasoning"), ("-instruct", ":instruct")


def thinks(model: Column) -> Column:
    """Whether a chat model thinks aloud unless told not to."""
    low = F.lower(model)
    return F.exists(F.array(*map(F.lit, THINKING)), lambda x: F.contains(low, x)) & ~F.exists(F.array(*map(F.lit, PLAIN)), lambda x: F.endswith(low, x))


def is_thinking(model: str) -> bool:
    """thinks() of one name."""
    return not model.lower().endswith(PLAIN) and any(x in model.lower() for x in THINKING)


def tool_model(model: str, provider: str, chosen: str | None = None, without_tools: frozenset[str] = frozenset(), proxy: str | None = None) -> str:
    """The model that calls tools: the chosen one, else the answering one unless it can't and a proxy stands in."""
    return chosen or (proxy if provider != "openai" and proxy and model in without_tools else model)
