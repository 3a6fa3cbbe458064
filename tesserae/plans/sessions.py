"""Threads of conversation: where they are kept, the loop between model and tools, and what a session is told."""

from __future__ import annotations

import html
import logging
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text
from ..operators import answering, store
from . import fixtures

LOG = logging.getLogger(__name__)
MESSAGES = "conv_id string, turn bigint, role string, text string, tool_calls int"
# What begins a new thread, and what ends a session.
NEW, LEAVE = "/new", ("exit", "quit", "q")


def thread_id(given: Column) -> Column:
    """The id of a thread, a new one where none is given."""
    return F.coalesce(given, F.expr("uuid()"))


def model_ids(shown: Column, ids: dict[str, str]) -> Column:
    """The id of the model that is shown under a name; any other name is an id itself."""
    known = F.create_map(*(F.lit(x) for pair in ids.items() for x in pair)) if ids else F.lit(None).cast("map<string,string>")
    return F.coalesce(F.try_element_at(known, shown), shown)


def command(line: str, thread: str) -> tuple[str, str]:
    """What a line asks for (skip, leave, new or ask), and the thread that goes on."""
    word = line.strip().lower()
    if not word:
        return "skip", thread
    if word in LEAVE:
        return "leave", thread
    return ("new", str(uuid.uuid4())) if word == NEW else ("ask", thread)


class Threads:
    """The messages of all threads: as written steps that go with the session ("memory"), or as a table by bucket of the thread that outlives it.

    No message passes through the driver. A step is written once, in the folder that all executors share, and read from there.
    """

    def __init__(self, spark: SparkSession, kind: str = "memory", path: str | None = None, buckets: int = 64):
        if kind not in ("memory", "table"):
            raise ValueError(f"no such store of threads: {kind}")
        self.spark, self.path, self.buckets = spark, path if kind == "table" else None, buckets
        if self.path is not None:
            try:
                if store.load(spark, self.path) is None:
                    spark.createDataFrame([], MESSAGES).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(self.path)
            except Exception as e:  # the store can't be used: the session goes on without it
                LOG.warning("threads are kept in memory: %s", e)
                self.path = None
        self._root, self._steps = None, []

    @property
    def kind(self) -> str:
        return "memory" if self.path is None else "table"

    def log(self) -> DataFrame:
        """All messages (conv_id, turn, role, text, tool_calls)."""
        if self.path is not None:
            return self.spark.read.schema(f"{MESSAGES}, bucket int").parquet(self.path).drop("bucket")
        return self.spark.read.schema(MESSAGES).parquet(*self._steps) if self._steps else self.spark.createDataFrame([], MESSAGES)

    def append(self, new: DataFrame) -> DataFrame:
        """Puts new messages (conv_id, ord, role, text, tool_calls) behind their threads' last turns; the rows as they were written."""
        if self._root is None:
            self._root = fixtures.folder(self.spark)
            where = self.spark._jvm.org.apache.hadoop.fs.Path(self._root)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(where)
        step = f"{self._root}/{len(self._steps)}"
        answering.following(self.log(), new.filter("conv_id IS NOT NULL")).to(StructType.fromDDL(MESSAGES)).write.parquet(step)
        self._steps.append(step)
        rows = self.spark.read.schema(MESSAGES).parquet(step)  # one step's messages: they don't move when the table grows
        if self.path is not None:
            bucket = F.pmod(F.xxhash64("conv_id"), F.lit(self.buckets)).cast("int")
            rows.withColumn("bucket", bucket).write.mode("append").partitionBy("bucket").parquet(self.path)
        return rows


def converse(threads: Threads, asked: DataFrame, model: Callable[[DataFrame], DataFrame], tools: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(conv_id, answer) for the questions asked (conv_id, text), all threads a step at a time.

    model turns the logs of threads into (conv_id, text, tool_calls); threads whose message calls a tool get what tools
    makes of (conv_id, text) and are asked again, until none calls one or the calls that a question may make are used up.
    Every step is appended to the threads, so a session that breaks off goes on from what was said.
    """
    say = lambda df, role: df.select("conv_id", F.lit(0).alias("ord"), F.lit(role).alias("role"), "text", (F.col("tool_calls") if "tool_calls" in df.columns else F.lit(0)).cast("int").alias("tool_calls"))
    live = threads.append(say(asked, "user"))
    for _ in range(answering.MAX_TOOL_CALLS + 1):
        said = threads.append(say(model(threads.log().join(live.select("conv_id").distinct(), "conv_id", "left_semi")), "assistant"))
        question = threads.log().filter("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("_since"))
        since = threads.log().join(question, "conv_id").filter("turn > _since")  # a question's own calls alone
        go_on = answering.tool_calls(since).filter("go_on").select("conv_id")
        calling = said.filter("tool_calls > 0").join(go_on, "conv_id", "left_semi")
        if calling.isEmpty():
            break
        live = threads.append(say(tools(calling.select("conv_id", "text")).select("conv_id", "text"), "tool"))
    last = threads.log().filter("role = 'assistant'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("answer"))
    return asked.select("conv_id").distinct().join(last, "conv_id")


def save_active(spark: SparkSession, path: str, doc_type: str, name: str) -> None:
    """Keeps which document type is active; its hints and domains stay with the taxonomy."""
    spark.createDataFrame([(doc_type, name)], "doc_type string, display_name string").coalesce(1).write.mode("overwrite").parquet(path)


def load_active(spark: SparkSession, path: str, domains: dict[str, dict[str, list[str]]] | None = None) -> tuple[str, str, dict[str, list[str]]]:
    """(type, name, domains) of the active document type, the fallback if none is kept or the kept one is unknown."""
    known = answering.DOMAINS if domains is None else domains
    try:
        row = spark.read.parquet(path).first()
    except AnalysisException:
        row = None
    kind, name = (row["doc_type"], row["display_name"]) if row else (answering.FALLBACK_TYPE, answering.FALLBACK_TYPE)
    return (kind, name, known[kind]) if kind in known else (answering.FALLBACK_TYPE, name, known.get(answering.FALLBACK_TYPE, {}))


def dump(chunks: DataFrame, path: str, keywords: list[str]) -> int:
    """Writes chunks as JSON lines; how many of them have one of the keywords."""
    chunks.write.mode("overwrite").json(path)
    return chunks.filter(text.contains_any(F.col("text"), keywords)).count()


def status(document: str | None, chunks: int | str = "-", nodes: int | str = "-", edges: int | str = "-", reranker: bool = False) -> str:
    """A line of HTML that says what is indexed."""
    shown = [f"{chunks} chunks", f"{nodes} nodes, {edges} edges", f"reranker {'on' if reranker else 'off'}"] if document else []
    return '<div class="status">' + "".join(f"<span>{html.escape(x)}</span>" for x in [document or "no document", *shown]) + "</div>"
