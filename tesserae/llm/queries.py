"""The registered queries of this subpackage, one for each operator, with production parameters over whole tables."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cascade, kneser_ney, mixing, pii, piece, sharding, simhash, sketch, suffix, warc

#: Target weights of named sources, and of all others together.
WEIGHTS, OTHER, SEED = {"src0": 0.2, "src1": 0.1, "src2": 0.1}, 0.6, 17
SHARDS = [f"shard-{k:03d}" for k in range(64)]
CRAWL_DATE = "2024-01-01T00:00:00Z"
#: The tokenizer's file; the setting tesserae.llm.tokenizer names another.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
#: The setting that holds the secret of the surrogates.
KEY = "tesserae.llm.pii.key"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of texts that comes in fewer files than half the cores (small ones of one row group) is dealt out."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name in ("documents", "pages") and len(rows.inputFiles()) < cores // 2 else rows


def tokenizer(spark: SparkSession) -> bytes:
    with open(spark.conf.get("tesserae.llm.tokenizer", TOKENIZER), "rb") as f:
        return f.read()


def key(spark: SparkSession) -> bytes:
    """The secret of the surrogates; without one in the settings a random one, which the session keeps and nobody else has."""
    if not spark.conf.get(KEY, ""):
        spark.conf.set(KEY, secrets.token_hex(32))
    return spark.conf.get(KEY).encode()


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(table(spark, sf_dir, "pages"), CRAWL_DATE))


def op2_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), WEIGHTS, OTHER, SEED)


def op3_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprint(table(spark, sf_dir, "documents"))


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), key(spark)).select("doc_id", "text", "lang", "source", "n_entities")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op8_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.judge(table(spark, sf_dir, "documents"))


def op9_lookup_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"), SHARDS, ["doc_id"])


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece.encode(table(spark, sf_dir, "documents"), tokenizer(spark))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc_derivatives, op2_poisson_mix, op3_simhash_components, op4_kneser_ney_quality, op5_scaled_sketch, op6_pii_surrogates, op7_suffix_dedup, op8_rule_cascade, op9_lookup_sharding, op10_sentencepiece)}


_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

_U = "CAST(CAST('0x' || substr(md5({0}), 1, 13) AS UBIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE"
_OWN = "coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))"

_MIX = f"""
WITH RECURSIVE named AS (SELECT *, CASE WHEN source IN ({", ".join(f"'{s}'" for s in WEIGHTS)}) THEN source END AS bucket FROM documents),
sizes AS (SELECT bucket, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS size FROM named GROUP BY bucket),
share(bucket, weight) AS (VALUES {", ".join(f"('{s}', CAST({w} AS DOUBLE))" for s, w in WEIGHTS.items())}, (NULL, CAST({OTHER} AS DOUBLE))),
used AS (SELECT share.bucket, weight, size FROM share JOIN sizes ON share.bucket IS NOT DISTINCT FROM sizes.bucket),
whole AS (SELECT bucket, CASE WHEN size > 0 THEN weight / (SELECT sum(weight) FROM used WHERE size > 0) * (SELECT sum(size) FROM sizes) / size ELSE 1 END AS rate FROM used),
rates AS (SELECT bucket, greatest(1, CAST(ceil(rate / 64) AS INTEGER)) AS draws, rate / greatest(1, ceil(rate / 64)) AS rate FROM whole),
steps(bucket, rate, k, term, total) AS (
  SELECT bucket, rate, CAST(0 AS DOUBLE), exp(-rate), exp(-rate) FROM rates
  UNION ALL
  SELECT bucket, rate, k + 1, term * rate / (k + 1), total + term * rate / (k + 1) FROM steps WHERE total < 1 AND (term > 1e-18 OR k < rate)),
cuts AS (SELECT bucket, list(total) AS cut FROM steps WHERE total < 1 AND (term > 1e-18 OR k < rate) GROUP BY bucket),
equal AS (SELECT *, count(*) AS times FROM named GROUP BY ALL),
drawn AS (SELECT equal.*, cut, {_OWN} AS own, times * draws AS tries FROM equal JOIN rates ON equal.bucket IS NOT DISTINCT FROM rates.bucket JOIN cuts ON equal.bucket IS NOT DISTINCT FROM cuts.bucket),
tried AS (SELECT own, doc_id, text, lang, source, n_chars, cut, unnest(range(tries)) AS t FROM drawn),
counted AS (SELECT own, doc_id, text, lang, source, n_chars, sum(len(list_filter(cut, lambda p: p <= {_U.format(f"'{SEED}:' || own || ':' || t")}))) AS n FROM tried GROUP BY ALL),
spread AS (SELECT * EXCLUDE (n), unnest(range(CAST(n AS BIGINT))) AS copy FROM counted)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy, {_U.format(f"'{SEED + 1}:' || own || ':' || copy")} AS mix_key FROM spread
"""

_RULES = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
spots AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS win FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM spots) WHERE n > 1),
repeats AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM again) GROUP BY r),
words AS (SELECT r, unnest(w) AS x FROM d),
tops AS (SELECT r, max(n) AS top_word FROM (SELECT r, x, count(*) AS n FROM words GROUP BY r, x) GROUP BY r),
letters AS (SELECT r, count(*) FILTER (WHERE regexp_matches(x, '\\p{{L}}')) AS letter_words FROM words GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(top_word, 0) AS top_word, coalesce(letter_words, 0) AS letter_words,
    length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) AS up, length(regexp_replace(text, '[^\\p{{Ll}}]', '', 'g')) AS low
  FROM d LEFT JOIN lines USING (r) LEFT JOIN repeats USING (r) LEFT JOIN tops USING (r) LEFT JOIN letters USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR 2 * n_dup_lines > n_lines OR 10 * letter_words < 7 * n_words OR 2 * up > up + low OR 4 * top_word > n_words) AS kept
FROM m
"""

_PLACES = f"""
WITH t AS (SELECT [{", ".join(map(str, sharding.lookup(SHARDS)))}] AS places),
d AS (SELECT *, CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13) AS UBIGINT) % {sharding.SLOTS} AS INTEGER) AS slot FROM documents)
SELECT d.*, 'shard-' || lpad(CAST(t.places[slot + 1] AS VARCHAR), 3, '0') AS shard FROM d, t
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_poisson_mix": _MIX, "op8_rule_cascade": _RULES, "op9_lookup_sharding": _PLACES}
