"""Training text from documents: quality classifier, SimHash near-dedup, surrogates for personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept; all but the last return the columns of
documents. Stages are written as Parquet in the shared checkpoint folder and read again, so a lost executor costs no more
than the tasks that it ran.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import kneser_ney, mixing, pii, piece, simhash
from tesserae.llm import queries as q
from tesserae.llm.common import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text is within their language's threshold."""
    judged = kneser_ney.judged(docs, q.table(spark, sf_dir, "labels"), ("text", "source", "n_chars"))
    return judged.filter("kept").select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: a resemblance of 0.8 or more in shingles of five words."""
    return simhash.keep_one(docs, width=5).select(*COLUMNS)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced; n_chars follows the text."""
    return pii.pseudonymise(docs, q.key(spark)).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in a global random order."""
    return mixing.mix(docs, q.WEIGHTS, q.OTHER, q.SEED).select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that was kept."""
    return piece.encode(docs, q.tokenizer(spark))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("pii_surrogates", surrogates),
    ("poisson_mix", mix_sources),
    ("sentencepiece", sentencepiece),
]

#: The classifier and the fingerprints have no SQL form; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from the whole of documents."""
    docs, scratch = q.table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, name)
    return docs
