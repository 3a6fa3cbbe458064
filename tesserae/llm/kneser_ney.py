"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

The model is of characters within words, a blank before and after each, so that words it never met are still judged by
their spelling. It is trained on the whole texts of all trusted documents with an even hash, so it grows with the corpus.
Its counts are sharded by n-gram: sums, left continuations, contexts and the probabilities of each length are grouped and
joined on n-gram keys. A model of at most MOST_SENT n-grams goes to the workers, which look words up in it; a larger one
stays sharded, and the n-grams of the corpus' distinct words are joined to it. Both give the same scores. A document's
perplexity, drawn towards its language's mean by PRIOR characters so that short texts aren't judged by chance, is held
against its language's quantile over all trusted documents with an odd hash: the one counted, or its upper bound by a normal
distribution of the logarithms if that is greater, as few documents say little about their tail.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound_batches

#: Characters of the longest n-gram.
ORDER = 5
#: n-grams (24 bytes each) and ids (8 bytes) that are sent to every worker; more are joined.
MOST_SENT, MOST_IDS = 2_000_000, 1_000_000
#: A language's threshold is this quantile of trusted documents' scores; weight of the language's mean in characters.
QUANTILE, PRIOR = 0.999, 40
#: How sure a quantile's upper bound is: languages with few trusted documents get a wider one.
SURE = 0.99
#: Trusted documents that a language needs for a threshold of its own, and languages whose thresholds go to all tasks; more are joined.
LEAST_TRUSTED, MOST_LANGUAGES = 20, 10_000
#: Words whose scores a worker keeps, n-grams that it counts before it passes them on, characters that it scores at a time.
CACHE, HELD, BLOCK = 300_000, 200_000, 1 << 18

_BLANKS = "[\\x20\\x09-\\x0D]+"
_WORDS, _OTHER_BLANKS = re.compile(r"[^\x20\x09-\x0D]+"), re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_U = np.uint64


def trusted(labels: DataFrame) -> DataFrame:
    """doc_id of the rows that every label of theirs calls good and none calls toxic."""
    return labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).filter("q = 1 and t = 0").select("doc_id")


def half(ids: DataFrame, odd: bool) -> DataFrame:
    """The ids with an odd hash, or those with an even one."""
    return ids.filter(F.xxhash64("doc_id").bitwiseAND(F.lit(1)) == int(odd))


def split(text: str) -> list[str]:
    """The words of a text; str.split() knows more blanks than are meant here."""
    return _WORDS.findall(text) if _OTHER_BLANKS.search(text) else text.split()


def grams(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, n): counts of the n-grams up to order that end in a word's characters or the blank after it.

    Workers pass on sums of at most about HELD n-grams, however long a text or a word is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["gram", "n"])
            held.clear()
            return made

        for batch in batches:
            words: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                words.update(split(text or ""))
            for word, n in words.items():
                s = f" {word} "
                for a in range(2, len(s) + 1, 1 << 14):
                    for e in range(a, min(a + (1 << 14), len(s) + 1)):
                        for b in range(max(0, e - order), e):
                            held[s[b:e]] += n
                    if len(held) > HELD:
                        yield out()
        yield out()

    bound_batches(texts.sparkSession)
    return texts.select(F.col("text").cast("string")).mapInArrow(run, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def counts(raw: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, c, total, n1, n2, n3): adjusted counts, and of each gram's context its total and its grams of count 1, 2 and more.

    The longest n-grams and those that begin a word have their own counts, others the number of characters they follow.
    """
    follows = raw.filter("length(gram) > 1").groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("left"))
    own = F.expr(f"length(gram) = {order} or (length(gram) > 1 and startswith(gram, ' '))")
    adjusted = raw.join(follows, "gram", "left").select("gram", F.when(own, F.col("n")).otherwise(F.coalesce("left", "n")).alias("c"), F.expr("substring(gram, 1, length(gram) - 1)").alias("h"))
    contexts = adjusted.groupBy("h").agg(F.sum("c").alias("total"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2"), F.count_if(F.col("c") > 2).alias("n3"))
    return adjusted.join(contexts, "h").select("gram", "c", "total", "n1", "n2", "n3")


def discounts(counted: DataFrame) -> dict[int, tuple[float, float, float]]:
    """By length of n-gram: what counts of 1, 2 and more are reduced by."""
    rows = counted.groupBy(F.length("gram").alias("k")).agg(*(F.count_if(F.col("c") == i).alias(f"t{i}") for i in (1, 2, 3, 4))).collect()
    out = {}
    for k, *t in rows:
        if all(t):
            y = t[0] / (t[0] + 2 * t[1])
            found = tuple(i + 1 - (i + 2) * y * t[i + 1] / t[i] for i in range(3))
        else:
            found = (0.5, 1.0, 1.5)
        out[k] = tuple(min(max(d, 0.05), i + 0.95) for i, d in enumerate(found))
    return out


def unseen(counted: DataFrame, reduced: dict[int, tuple[float, float, float]]) -> tuple[float, float]:
    """Probability of a character, all alike, of which 256 are kept for unknown ones; log probability of an unknown one."""
    row = counted.filter("length(gram) = 1").agg(F.count("*").alias("symbols"), *(F.max(c).alias(c) for c in ("total", "n1", "n2", "n3"))).first()
    alike, d = 1.0 / (row["symbols"] + 256), reduced[1]
    return alike, math.log((d[0] * row["n1"] + d[1] * row["n2"] + d[2] * row["n3"]) / row["total"] * alike)


def probabilities(counted: DataFrame, reduced: dict[int, tuple[float, float, float]], alike: float, scratch: Scratch, order: int = ORDER) -> DataFrame:
    """(gram, p, w): the log probability of an n-gram's last character, and the log weight of the shorter context after it as context.

    Each length is joined to the one below it, on the n-gram without its first character. Either may be null.
    """
    levels, weights = [], []
    for k in range(1, order + 1):
        d = reduced.get(k, (0.5, 1.0, 1.5))
        own = counted.filter(F.length("gram") == k).withColumn("w", (F.lit(d[0]) * F.col("n1") + F.lit(d[1]) * F.col("n2") + F.lit(d[2]) * F.col("n3")) / F.col("total"))
        if k == 1:
            own = own.withColumn("below", F.lit(alike))
        else:
            own = own.join(levels[-1].select(F.col("gram").alias("rest"), F.col("p").alias("below")), F.expr("substring(gram, 2)") == F.col("rest"), "left")
            weights.append(own.select(F.expr(f"substring(gram, 1, {k - 1})").alias("h"), "w").distinct())
        less = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        p = F.greatest(F.col("c") - less, F.lit(0.0)) / F.col("total") + F.col("w") * F.coalesce("below", F.lit(0.0))
        levels.append(scratch.save(own.select("gram", p.alias("p")), f"level{k}"))
    known, backoff = levels[0], weights[0] if weights else None
    for more in levels[1:]:
        known = known.unionByName(more)
    for more in weights[1:]:
        backoff = backoff.unionByName(more)
    backoff = backoff if backoff is not None else counted.limit(0).select(F.col("gram").alias("h"), F.lit(0.0).alias("w"))
    met = known.join(backoff, F.col("gram") == F.col("h"), "full")
    positive = lambda c: F.when(F.col(c) > 0, F.ln(c))
    return met.select(F.coalesce("gram", "h").alias("gram"), positive("p").alias("p"), positive("w").alias("w"))


def _keys(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """By length up to order, 64-bit hashes of the n-grams that begin at each code point."""
    h, out = np.zeros(len(codes), _U), []
    for k in range(order):
        n = max(0, len(codes) - k)
        h = (h[:n] + codes[k:] + _U(1)) * _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(29)
        h *= _U(0xC2B2AE3D27D4EB4F)
        h ^= h >> _U(32)
        out.append(h)
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(_U)


def sent(model: DataFrame, log_unseen: float, order: int = ORDER) -> tuple:
    """A model as arrays, which executors can read without this package: hashes of its n-grams in order, their p and w."""
    table = model.toArrow()
    names = table["gram"].to_pylist()
    size = np.fromiter(map(len, names), np.int64, len(names))
    at, every = np.cumsum(size) - size, _keys(_codes("".join(names)), order)
    keys = np.zeros(len(names), _U)
    for k in range(order):
        keys[size == k + 1] = every[k][at[size == k + 1]]
    ranks = np.argsort(keys)
    if (np.diff(keys[ranks]) == 0).any():
        raise ValueError("two n-grams of the model have one hash")
    p, w = (table[c].to_numpy().astype(np.float64)[ranks] for c in ("p", "w"))
    return order, log_unseen, keys[ranks], p, np.nan_to_num(w, nan=0.0)


class Model:
    """Scores words with the arrays that sent() made."""

    def __init__(self, parts: tuple):
        self.order, self.unseen, self.keys, self.p, self.w = parts
        bits = max(1, len(self.keys).bit_length() + 1)
        self.shift = _U(64 - bits)
        self.first = np.append(np.searchsorted(self.keys, np.arange(1 << bits, dtype=_U) << self.shift), len(self.keys))

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each hash among the keys, or -1: keys with the same leading bits are tried in order."""
        bucket = (wanted >> self.shift).astype(np.int64)
        at, end, out = self.first[bucket], self.first[bucket + 1], np.full(len(wanted), -1, np.int64)
        live = np.flatnonzero(at < end)
        while len(live):
            key, want = self.keys[at[live]], wanted[live]
            hit = live[key == want]
            out[hit] = at[hit]
            live = live[key < want]
            at[live] += 1
            live = live[at[live] < end[live]]
        return out

    def logs(self, codes: np.ndarray) -> np.ndarray:
        """The log probability of each character but the first of blank-separated words with a blank on both sides."""
        n, order = len(codes), self.order
        place = np.arange(n)
        last = np.maximum.accumulate(np.where(codes == 32, place, -order))
        depth = np.minimum(order, place - np.concatenate(([-order], last[:-1])) + 1)  # from the blank before a word
        keys, out, open_ = _keys(codes, order), np.zeros(n), place > 0
        for k in range(order, 0, -1):
            ends = np.flatnonzero(open_ & (depth >= k) & (place >= k - 1))
            found = self.find(keys[k - 1][ends - k + 1])
            p = np.where(found >= 0, self.p[found], np.nan) if len(self.p) else np.full(len(ends), np.nan)
            known = ~np.isnan(p)
            out[ends[known]] += p[known]
            open_[ends[known]] = False
            rest = ends[~known]
            if k == 1:
                out[rest] += self.unseen
            elif len(self.w):
                h = self.find(keys[k - 2][rest - k + 1])
                out[rest] += np.where(h >= 0, self.w[h], 0.0)
        return out

    def words(self, words: list[str]) -> np.ndarray:
        """The log probability of each word's characters and the blank after it."""
        if not words:
            return np.zeros(0)
        codes = _codes(f" {' '.join(words)} ")
        logs, back = np.zeros(len(codes)), self.order
        for a in range(0, len(codes), BLOCK):
            b = max(0, a - back)  # as much of what comes before as an n-gram can reach
            logs[a : a + BLOCK] = self.logs(codes[b : a + BLOCK])[a - b :]
        return np.add.reduceat(logs[1:], np.flatnonzero(codes == 32)[:-1])


class _Texts:
    """Scores of texts; those of words are kept while there are at most CACHE."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def score(self, texts: list[str | None]) -> Iterator[tuple[int, int, float]]:
        """(words, characters with a blank for each word, negative log probability) of each text."""
        lists = [split(t or "") for t in texts]
        if len(self.known) > CACHE:
            self.known.clear()
        fresh = list(set(chain.from_iterable(lists)) - self.known.keys())
        self.known.update(zip(fresh, self.model.words(fresh).tolist(), strict=True))
        for words in lists:
            yield len(words), sum(map(len, words)) + len(words), -math.fsum(map(self.known.__getitem__, words))
        for word in fresh:
            if len(word) > 64:
                del self.known[word]


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch, order: int = ORDER) -> tuple[DataFrame, float] | None:
    """The model's table and the log probability of an unknown character; None without trusted text.

    Trained on all trusted documents with an even hash, or on all if none has one.
    """
    ids = trusted(labels).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    even = half(ids, False)
    ids = scratch.save(ids if even.isEmpty() else even, "training")
    texts = docs.join(F.broadcast(ids) if ids.count() <= MOST_IDS else ids, "doc_id", "left_semi").select("text")
    counted = scratch.save(counts(scratch.save(grams(texts, order), "grams"), order), "counts")
    if counted.isEmpty():
        return None
    reduced = discounts(counted)
    alike, log_unseen = unseen(counted, reduced)
    return scratch.save(probabilities(counted, reduced, alike, scratch, order), "model"), log_unseen


def scores(docs: DataFrame, model: DataFrame, log_unseen: float, extra: tuple[str, ...] = (), order: int = ORDER, most_sent: int = MOST_SENT) -> DataFrame:
    """doc_id, lang, n_words, n_scored (characters, with a blank for each word) and nll of every row, and the extra columns."""
    rest = [F.col(c) for c in extra if c != "text"]
    docs = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), *rest)
    if model.count() > most_sent:
        return _joined_scores(docs, model, log_unseen, order).select("doc_id", "lang", "n_words", "n_scored", "nll", *extra)
    shared = docs.sparkSession.sparkContext.broadcast(sent(model, log_unseen, order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = _Texts(Model(shared.value))
        for batch in batches:
            rows, group, size = [], [], 0
            for text in batch.column(2).to_pylist():
                group.append(text)
                size += len(text or "")
                if size >= BLOCK:
                    rows += texts.score(group)
                    group, size = [], 0
            rows += texts.score(group)
            made = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made, *(batch.column(c) for c in extra)], ["doc_id", "lang", "n_words", "n_scored", "nll", *extra])

    bound_batches(docs.sparkSession)
    kind = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = f"doc_id {kind['doc_id']}, lang string, n_words bigint, n_scored bigint, nll double" + "".join(f", {c} {kind[c]}" for c in extra)
    return docs.mapInArrow(run, schema)


def _joined_scores(docs: DataFrame, model: DataFrame, log_unseen: float, order: int) -> DataFrame:
    """docs with n_words, n_scored and nll: the n-grams of the distinct words are joined to the sharded model, words to texts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = f" {word} "
                for e in range(2, len(s) + 1):
                    rows += ((key, e, e - b, s[b:e]) for b in range(max(0, e - order), e))
                    if len(rows) >= 1 << 16:
                        yield pack(rows)
                        rows = []
            yield pack(rows)

    def pack(rows):
        cols = zip(*rows, strict=True) if rows else [[]] * 4
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.string()), strict=True)], ["w", "e", "k", "gram"])

    bound_batches(docs.sparkSession)
    words = F.filter(F.split(F.coalesce("text", F.lit("")), _BLANKS), lambda w: w != "")
    keyed = docs.withColumn("__tess_t", F.md5(F.coalesce("text", F.lit(""))))
    # rows with one text are counted together, then shared out: a text's own words are n / copies
    counted = keyed.select("__tess_t", F.explode(words).alias("word")).groupBy("__tess_t", "word").agg(F.count("*").alias("n"))
    copies = keyed.groupBy("__tess_t").agg(F.count("*").alias("copies"))
    spots = counted.select("word").distinct().select(F.md5("word").alias("w"), "word").mapInArrow(cut, "w string, e bigint, k int, gram string")
    p, weight = model.select("gram", "p"), model.select(F.col("gram").alias("h"), F.col("w").alias("weight"))
    met = spots.join(p, "gram", "left").join(weight, F.expr("substring(gram, 1, k - 1)") == F.col("h"), "left")
    longest = F.max(F.when(F.col("p").isNotNull(), F.struct("k", "p")))
    steps = F.collect_list(F.struct("k", F.coalesce("weight", F.lit(0.0)).alias("weight")))  # one for each length up to order
    best = met.groupBy("w", "e").agg(longest.alias("best"), steps.alias("steps"))
    backed = F.expr("aggregate(filter(steps, x -> x.k > coalesce(best.k, 1)), 0D, (s, x) -> s + x.weight)")
    scored = best.groupBy("w").agg(F.sum(F.coalesce("best.p", F.lit(log_unseen)) + backed).alias("log"))
    per_text = counted.select("__tess_t", F.md5("word").alias("w"), "n").join(scored, "w").groupBy("__tess_t").agg(F.sum(F.col("n") * F.col("log")).alias("log"))
    per_text = per_text.join(copies, "__tess_t").select("__tess_t", (-F.col("log") / F.col("copies")).alias("nll"))
    sized = keyed.join(per_text, "__tess_t", "left").withColumn("nll", F.coalesce("nll", F.lit(0.0))).withColumn("n_words", F.size(words).cast("bigint"))
    return sized.withColumn("n_scored", F.aggregate(words, F.col("n_words"), lambda s, w: s + F.length(w))).drop("__tess_t")


def limits(scored: DataFrame, labels: DataFrame, scratch: Scratch, quantile: float = QUANTILE) -> tuple[DataFrame | None, tuple[float, float] | None]:
    """(lang, mean, cut) of all languages with LEAST_TRUSTED documents, and of all together; of trusted rows with an odd hash, or of all if there are none."""
    held = scored.join(trusted(labels), "doc_id", "left_semi").filter("n_scored > 0").select("doc_id", "lang", "n_scored", "nll")
    outside = half(held, True)
    outside = scratch.save(held if outside.isEmpty() else outside, "outside")
    mean = (F.sum("nll") / F.sum("n_scored")).alias("mean")
    whole = outside.agg(mean).first()["mean"]
    if whole is None:
        return None, None
    means = scratch.save(outside.filter("lang is not null").groupBy("lang").agg(F.count("*").alias("n"), mean).filter(F.col("n") >= LEAST_TRUSTED).select("lang", "mean", F.lit(0.0).alias("cut")), "means")
    drawn = docs_limits(outside, means, (whole, 0.0))
    # the quantile's upper bound at the level SURE by a normal distribution of the logarithms (a one-sided tolerance limit)
    z, sure, n = NormalDist().inv_cdf(quantile), NormalDist().inv_cdf(SURE), F.count("*")
    a, b = F.greatest(1 - sure**2 / (2 * F.greatest(n - 1, F.lit(1))), F.lit(0.1)), z**2 - sure**2 / n
    tail = F.exp(F.avg(F.ln("score")) + (z + F.sqrt(F.greatest(z**2 - a * b, F.lit(0.0)))) / a * F.coalesce(F.stddev(F.ln("score")), F.lit(0.0)))
    cut = F.greatest(F.percentile_approx("score", quantile, 100_000), tail).alias("cut")
    own = scratch.save(means.drop("cut").join(drawn.filter("own").groupBy("lang").agg(cut), "lang"), "limits")
    return own, (whole, drawn.agg(cut).first()["cut"])


def docs_limits(scored: DataFrame, by_lang: DataFrame | None, whole: tuple[float, float]) -> DataFrame:
    """scored with threshold, own (its language has one) and score: the perplexity drawn towards the mean."""
    if by_lang is None:
        met = scored.withColumns({"__tess_lang": F.lit(None).cast("string"), "__tess_mean": F.lit(None).cast("double"), "__tess_cut": F.lit(None).cast("double")})
    else:
        table = by_lang.select(F.col("lang").alias("__tess_lang"), F.col("mean").alias("__tess_mean"), F.col("cut").alias("__tess_cut"))
        table = F.broadcast(table) if table.limit(MOST_LANGUAGES + 1).count() <= MOST_LANGUAGES else table
        met = scored.join(table, F.col("lang") == F.col("__tess_lang"), "left")
    mean = F.coalesce("__tess_mean", F.lit(whole[0]))
    score = F.exp((F.col("nll") + PRIOR * mean) / (F.col("n_scored") + PRIOR))
    return met.withColumn("own", F.col("__tess_lang").isNotNull()).withColumn("threshold", F.coalesce("__tess_cut", F.lit(whole[1]))).withColumn("score", score).drop("__tess_lang", "__tess_mean", "__tess_cut")


def judged(docs: DataFrame, labels: DataFrame, extra: tuple[str, ...] = (), quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_words, perplexity, score, threshold and kept of every row of docs (doc_id, text, lang, ...), and extra columns.

    A document is rejected if its score is above its language's threshold, not if it is equal; languages with fewer than
    LEAST_TRUSTED trusted documents, null included, have the threshold of all together. Texts of any length are scored whole. A null or blank text has no perplexity and is kept, and
    so is every row if nothing is trusted. Repeated rows are judged alike and all count; an empty table gives an empty
    result. labels: (doc_id, quality, toxic, ...); of several labels the worst counts, null is as 0.
    """
    scratch = Scratch(docs.sparkSession, "kneser")
    model = train(docs, labels, scratch)
    if model is None:
        by_lang, whole = None, None
        found = scores(docs, docs.sparkSession.createDataFrame([], "gram string, p double, w double"), 0.0, extra)
    else:
        found = scratch.save(scores(docs, *model, extra), "scores")  # every text is scored once
        by_lang, whole = limits(found, labels, scratch, quantile)
        scratch.drop("training", "grams", "counts", "outside", *(f"level{k}" for k in range(1, ORDER + 1)))
    out = docs_limits(found, by_lang, whole or (0.0, float("inf")))
    known = (F.col("n_scored") > 0) & F.lit(whole is not None)
    return out.select(
        "doc_id", "lang", "n_words", F.when(known, F.exp(F.col("nll") / F.col("n_scored"))).alias("perplexity"), F.when(known, F.col("score")).alias("score"), F.when(F.lit(whole is not None), F.col("threshold")).alias("threshold"),
        F.when(known, F.col("score") <= F.col("threshold")).otherwise(True).alias("kept"), *extra,
    )
