"""Quality rules as a short-circuit cascade.

The base measures are part of the result and made for every text. The rules come after them: each rule's cost, given what
the base has measured, and the texts that it rejects are estimated on a sample of those that pass the base. The order is
built rule by rule: next comes the one that rejects most of the texts that get that far per second. A document is rejected
by the first rule that it fails; the others aren't tried. The order changes the cost, never the verdict.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

SYMBOLS = "[#*$%&|<>]"
_BLANK, _SYMBOL, _WORDS = re.compile(r"[\x20\x09-\x0D]"), re.compile(SYMBOLS), re.compile(r"[^\x20\x09-\x0D]+")
#: Words of a window that may repeat.
WINDOW = 8


class Text:
    """A text and its measures, each computed when it is first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - len(_BLANK.findall(self.text))

    @cached_property
    def n_symbols(self) -> int:
        return len(_SYMBOL.findall(self.text))

    @cached_property
    def lines(self) -> list[bytes]:
        """The lines with a word."""
        return [x for x in self.text.encode("utf-8", "surrogatepass").split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in windows of WINDOW words found twice or more: windows are told apart by ranks, doubled from word ranks."""
        n = len(self.words)
        if n <= WINDOW:
            return 0
        seen: dict[bytes, int] = {}
        rank = np.fromiter((seen.setdefault(w, len(seen)) for w in self.words), np.int64, n)
        if len(seen) == n:
            return 0
        step = 1
        while step < WINDOW:
            pairs = rank[:-step] * np.int64(n + 1) + rank[step:]
            _, rank, count = np.unique(pairs, return_inverse=True, return_counts=True)
            if len(count) == len(rank):
                return 0
            step *= 2
        again = np.concatenate((count[rank] > 1, np.zeros(WINDOW - 1, bool)))
        covered = np.convolve(again, np.ones(WINDOW, np.int64))[:n] > 0
        return int(covered.sum())

    @cached_property
    def letter_words(self) -> int:
        """Words with a letter."""
        return sum(1 for w in _WORDS.findall(self.text) if w.isalpha() or any(map(str.isalpha, w)))

    @cached_property
    def capitals(self) -> tuple[int, int]:
        """Capitals among the letters that have case, and all of these."""
        up = sum(map(str.isupper, self.text))
        return up, up + sum(map(str.islower, self.text))

    @cached_property
    def top_word(self) -> int:
        seen: dict[bytes, int] = {}
        for w in self.words:
            seen[w] = seen.get(w, 0) + 1
        return max(seen.values(), default=0)


    def after_base(self) -> Text:
        """The text with the base measures alone, as it comes to the rules."""
        made = Text(self.text)
        made.__dict__.update({k: v for k, v in self.__dict__.items() if k in BASE})
        return made


#: What has been made of a text when the rules begin.
BASE = ("words", "n_words", "word_chars", "n_symbols", "lines", "n_dup_lines", "n_repeat_words")


def measured(text: str | None) -> tuple[Text, bool]:
    """A text with its base measures, and whether it fails by them."""
    t = Text(text)
    for name in BASE:
        getattr(t, name)
    return t, t.n_words < 20 or 100 * t.n_repeat_words > 30 * t.n_words


#: name: what makes a text fail that passed the base. Each is a rate, so it doesn't depend on length.
RULES: dict[str, Callable[[Text], bool]] = {
    "symbols": lambda t: 10 * t.n_symbols > t.n_words,
    "word_length": lambda t: not 2 * t.n_words <= t.word_chars <= 15 * t.n_words,
    "same_lines": lambda t: 2 * t.n_dup_lines > len(t.lines),
    "letterless_words": lambda t: 10 * t.letter_words < 7 * t.n_words,
    "capitals": lambda t: 2 * t.capitals[0] > t.capitals[1],
    "one_word": lambda t: 4 * t.top_word > t.n_words,
}


def estimate(docs: DataFrame, rules: dict[str, Callable[[Text], bool]], sample: int) -> tuple[dict[str, float], dict[int, int]]:
    """Seconds that each rule takes a text, and how many texts fail just the rules of a mask, of about sample rows that pass the base.

    Rows are drawn one by one, whatever they hold, so that no repeated text or id fills the sample. What comes to the
    driver is a row for each rule, and one for each mask, of which there are no more than rows in the sample.
    """
    few = docs.sample(min(1.0, sample / max(docs.count(), 1)), seed=7)
    names = list(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                t, failed = measured(text)
                if failed:
                    continue
                mask, spent = 0, []
                for k, name in enumerate(names):
                    one, began = t.after_base(), time.perf_counter()
                    mask |= bool(rules[name](one)) << k
                    spent.append(time.perf_counter() - began)
                rows.append((mask, spent))
            cols = list(zip(*rows, strict=True)) if rows else [[], []]
            yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.list_(pa.float64()))], ["mask", "s"])

    tried = few.select(F.col("text").cast("string")).mapInArrow(run, "mask bigint, s array<double>")
    found = tried.groupBy("mask").agg(F.count("*").alias("n"), *(F.sum(F.get("s", F.lit(k))).alias(f"s{k}") for k in range(len(names)))).collect()
    n = max(sum(r["n"] for r in found), 1)
    return {name: sum(r[f"s{k}"] for r in found) / n for k, name in enumerate(names)}, {r["mask"]: r["n"] for r in found}


def ordered(seconds: dict[str, float], masks: dict[int, int]) -> list[str]:
    """The rules, next always the one that rejects most per second of the texts that all before it passed; cheap ones first among those that reject none."""
    names, order, left = list(seconds), [], dict(masks)
    while len(order) < len(names):
        rejects = {k: sum(n for mask, n in left.items() if mask >> k & 1) for k in range(len(names)) if names[k] not in order}
        best = min(rejects, key=lambda k: (-rejects[k] / max(seconds[names[k]], 1e-9), seconds[names[k]], names[k]))
        order.append(names[best])
        left = {mask: n for mask, n in left.items() if not mask >> best & 1}
    return order


def judge(docs: DataFrame, rules: dict[str, Callable[[Text], bool]] | None = None, sample: int = 2_000) -> DataFrame:
    """The base measures, base_failed and kept of every row of docs (doc_id, text, ...).

    kept: neither the base verdict nor a rule of the cascade rejects the text. A null text has no words and fails; the
    same text always gets the same verdict, repeated rows and rows without an id each their own; texts are measured whole,
    however long; an empty table gives an empty result. Other columns are not looked at.
    """
    rules = RULES if rules is None else rules
    bound_batches(docs.sparkSession)
    order = ordered(*estimate(docs, rules, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                t, base = measured(text)
                kept = not base and not any(rules[k](t) for k in order)
                rows.append((t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, base, kept))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            made = [pa.array(c, pa.int64()) for c in cols[:5]] + [pa.array(c, pa.bool_()) for c in cols[5:]]
            yield pa.record_batch([batch.column(0), *made], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean")
