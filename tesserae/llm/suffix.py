"""Exact substring removal by column-wise construction of a multi-document Burrows-Wheeler order.

A byte goes if a string of `length` bytes that covers it also starts anywhere else. The order is built as in column-wise
multi-document construction: each round inserts one symbol of every document, moves each document to its new place among
the suffixes of this column, and updates the common prefixes of neighbours. A string that is repeated has a neighbour
with a common prefix of `length` bytes or more.

Inserted column by column, whole documents would take as many rounds as the longest has bytes, each a pass over all that
was inserted. So the collection is dealt out first. Every window of `length` bytes selects as its anchor the K bytes with
the least hash in it, the first of equal ones; equal windows select equal anchors at the same offset. Consecutive windows
with one anchor form a piece of at most 2 * length bytes. An anchor that occurs once holds no repeated window. A piece
that occurs twice in full is repeated in full. Only distinct pieces whose anchors also occur in other pieces are inserted,
aligned at their anchors: then equal windows lie in the same column, and each round needs only the order and prefixes of
the column before it. These two arrays replace the external files: they are bounded by the pieces of a block, and an
executor has no folder that would survive it.

An anchor with more distinct pieces than a block holds is resolved by hashes of its single windows instead, which are
counted with partial sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bound_batches

#: Bytes of an anchor, a power of two.
K = 32
#: Bytes of text whose windows are hashed at a time, and the distinct pieces of one block of the construction.
CHUNK, BLOCK = 1 << 20, 1 << 15

#: Windows of a piece and its anchor's offset are kept in 8 bits each.
MOST = 255 + K - 1
#: Bytes of a text whose runs are merged together first.
STRETCH = 1 << 16

_U = np.uint64


def _mixed(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the K bytes from each position, by doubling."""
    a, b, s = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(29)
    h = (data.astype(_U) + _U(1)) * a
    h ^= h >> s
    h *= b
    step = 1
    while step < K:
        h = h[:-step] * a + (h[step:] ^ (h[step:] >> s)) * b
        h ^= h >> s
        step *= 2
    return h


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of width keys."""
    step = 1
    while 2 * step <= width:
        keys = np.minimum(keys[:-step], keys[step:])
        step *= 2
    return np.minimum(keys[: len(keys) - (width - step)], keys[width - step :]) if width > step else keys


def pieces(data: bytes, bounds: list[tuple[int, int]], length: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(text, anchor hash, piece hash, first window, windows, anchor's offset) of the texts that lie at bounds in data."""
    flat = np.frombuffer(data, np.uint8)
    if len(flat) < length:
        return
    h = _mixed(flat)
    low = _U(24)
    at = (_least((h >> low << low) | np.arange(len(h), dtype=_U), length - K + 1) & _U(0xFFFFFF)).astype(np.int64)
    hash64, view = xxhash.xxh3_64_intdigest, memoryview(data)
    signed = h.view(np.int64)
    for text, (a, b) in enumerate(bounds):
        if b - a < length:
            continue
        own = at[a : b - length + 1]
        first = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1))
        last = np.concatenate((first[1:], [len(own)]))
        anchor = own[first]
        for s, e, p, x in zip((first + a).tolist(), (last + a).tolist(), anchor.tolist(), signed[anchor].tolist(), strict=True):
            c = hash64(view[s : e - 1 + length], p - s)
            yield text, x, c - (1 << 64) if c >> 63 else c, s - a, e - s, p - s


def all_pieces(docs: DataFrame, length: int) -> DataFrame:
    """(a, c, doc_id, th, at): anchor hash, piece hash, whose text it is in, and where: first window, count and offset in one long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths, texts = batch.column(0), batch.column(1), batch.column(2)
            parts: list[tuple[int, int, bytes]] = []  # row, offset in it, bytes
            held = 0

            def out(parts):
                bounds, k = [], 0
                for _, _, x in parts:
                    bounds.append((k, k + len(x)))
                    k += len(x)
                rows = list(pieces(b"".join(x for _, _, x in parts), bounds, length))
                if not rows:
                    return
                t, a, c, s, n, o = (np.array(x, np.int64) for x in zip(*rows, strict=True))
                row, base = (np.array([p[k] for p in parts], np.int64)[t] for k in (0, 1))
                take = pa.array(row)
                yield pa.record_batch([pa.array(a), pa.array(c), ids.take(take), ths.take(take), pa.array((base + s) << 16 | n << 8 | o)], ["a", "c", "doc_id", "th", "at"])

            for row, text in enumerate(texts):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                for k in range(0, max(1, len(data) - length + 1), CHUNK):  # windows of a part begin in its first CHUNK bytes
                    part = data[k : k + CHUNK + length - 1]
                    if len(part) < length:
                        continue
                    if held + len(part) > 2 * CHUNK:
                        yield from out(parts)
                        parts, held = [], 0
                    parts.append((row, k, part))
                    held += len(part)
            yield from out(parts)

    return docs.select("doc_id", "th", "text").mapInArrow(run, f"a bigint, c bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, th bigint, at bigint")


def repeated(strings: list[bytes], offsets: list[int], length: int) -> np.ndarray:
    """For the window at each column, up to the anchor's, whether it is repeated: [column, string].

    The column-wise construction. String i is inserted from its last symbol to its first, with offsets[i] at the anchor's
    column; order holds the strings by their suffixes from the current column on, prefix the bytes that each shares with
    the one before it, no more than length.
    """
    m, lens, offs = len(strings), np.fromiter(map(len, strings), np.int64), np.array(offsets, np.int64)
    left = int(offs.max(initial=0))
    width = left + int((lens - offs).max(initial=0))
    table = np.full((m, width), 256, np.uint16)  # 256: no symbol
    for i, (s, k) in enumerate(zip(strings, (left - offs).tolist(), strict=True)):
        table[i, k : k + len(s)] = np.frombuffer(s, np.uint8)
    table = np.ascontiguousarray(table.T)
    order, prefix = np.arange(m), np.zeros(m + 1, np.int64)
    found = np.zeros((left + 1, m), bool)
    for column in range(width - 1, -1, -1):
        symbols = table[column][order]
        perm = np.argsort(symbols, kind="stable")
        sorted_symbols, u, v = symbols[perm], perm[:-1], perm[1:]
        same = (sorted_symbols[1:] == sorted_symbols[:-1]) & (sorted_symbols[1:] != 256)
        shared = prefix[v]
        apart = np.flatnonzero(same & (v != u + 1))
        if len(apart):
            shared[apart] = np.minimum.reduceat(prefix, np.stack([u[apart] + 1, v[apart] + 1], axis=1).ravel())[::2]
        prefix = np.zeros(m + 1, np.int64)
        prefix[1:m] = np.where(same, np.minimum(shared + 1, length), 0)
        order = order[perm]
        if column <= left:
            long = prefix >= length
            found[column, order] = long[:m] | long[1 : m + 1]
    return found


def _spans(rows: DataFrame, length: int, id_type: str) -> DataFrame:
    """(doc_id, th, b, e): the runs of bytes that repeated windows of the pieces (a, piece, doc_id, th, at, need) cover."""

    def solve(block):
        left = max(o for _, o, *_ in block)
        found = repeated([x for x, *_ in block], [o for _, o, *_ in block], length)
        for i, (data, o, doc, th, s, need) in enumerate(block):
            if not need:
                continue
            hit = np.flatnonzero(found[left - o : left - o + len(data) - length + 1, i])
            if len(hit):
                cut = np.flatnonzero(np.diff(hit) > 1)
                for b, e in zip(hit[np.concatenate(([0], cut + 1))].tolist(), hit[np.concatenate((cut, [len(hit) - 1]))].tolist(), strict=True):
                    yield doc, th, s + b, s + e + length

    def pack(rows):
        rows = list(rows)
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        schema = pa.schema([("doc_id", types[0]), ("th", pa.int64()), ("b", pa.int64()), ("e", pa.int64())])
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

    types: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, last = [], None
        for batch in batches:
            types[:] = [batch.schema.field("doc_id").type]
            for a, data, doc, th, at, need in zip(*(batch.column(k).to_pylist() for k in ("a", "piece", "doc_id", "th", "at", "need")), strict=True):
                if a != last and len(block) >= BLOCK:
                    yield from pack(solve(block))
                    block = []
                block.append((data, at & 255, doc, th, at >> 16, need))
                last = a
        if block:
            yield from pack(solve(block))

    return rows.mapInArrow(run, f"doc_id {id_type}, th bigint, b bigint, e bigint")


def _windows(rows: DataFrame, length: int, id_type: str) -> DataFrame:
    """(w, doc_id, th, s, need): the 128-bit hash of every single window of the pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, doc, th, at, need in zip(*(batch.column(k).to_pylist() for k in ("piece", "doc_id", "th", "at", "need")), strict=True):
                out += [(xxhash.xxh3_128_digest(data[k : k + length]), doc, th, (at >> 16) + k, need) for k in range(len(data) - length + 1)]
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            schema = pa.schema([("w", pa.binary()), ("doc_id", batch.schema.field("doc_id").type), ("th", pa.int64()), ("s", pa.int64()), ("need", pa.bool_())])
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

    return rows.mapInArrow(run, f"w binary, doc_id {id_type}, th bigint, s bigint, need boolean")


def repeated_spans(docs: DataFrame, length: int = 200, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, th, b, e): runs of bytes to remove from the texts of docs (doc_id, th, text); they may overlap."""
    scratch = scratch or Scratch(docs.sparkSession, "suffix")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    every = scratch.save(all_pieces(docs, length), "pieces")
    anchors = every.groupBy("a").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("n > 1")
    anchors = scratch.save(anchors.select("a", F.expr("lo <> hi").alias("mixed")), "anchors")  # written, so that the join can split a frequent anchor
    met = scratch.save(every.join(anchors, "a"), "met")
    scratch.drop("pieces", "anchors")
    distinct = met.filter("mixed").groupBy("a", "c").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "at")).alias("r"))
    distinct = scratch.save(distinct, "distinct")
    whole = met.filter("not mixed").select("doc_id", "th", "at")
    whole = whole.unionByName(met.filter("mixed").join(distinct.filter("n > 1").select("a", "c"), ["a", "c"]).select("doc_id", "th", "at"))
    whole = whole.select("doc_id", "th", F.expr("shiftright(at, 16)").alias("b"), F.expr(f"shiftright(at, 16) + (shiftright(at, 8) & 255) + {length - 1}").alias("e"))

    want = distinct.groupBy("r.doc_id", "r.th").agg(F.collect_list(F.struct("a", F.col("r.at").alias("at"), F.expr("n = 1").alias("need"))).alias("want"))  # a text's own pieces
    want = want.withColumnsRenamed({"doc_id": "_doc", "th": "_th"})
    held = docs.join(want, docs["doc_id"].eqNullSafe(F.col("_doc")) & (docs["th"] == F.col("_th")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data = (batch.column(2)[row].as_py() or "").encode("utf-8", "surrogatepass")
                wants = batch.column(3)[row].as_py()
                ids, ths = (pa.concat_arrays([batch.column(k).slice(row, 1)] * len(wants)) for k in (0, 1))
                yield pa.record_batch(
                    [
                        pa.array([w["a"] for w in wants], pa.int64()),
                        pa.array([data[w["at"] >> 16 : (w["at"] >> 16) + (w["at"] >> 8 & 255) + length - 1] for w in wants], pa.binary()),
                        ids,
                        ths,
                        pa.array([w["at"] for w in wants], pa.int64()),
                        pa.array([w["need"] for w in wants], pa.bool_()),
                    ],
                    ["a", "piece", "doc_id", "th", "at", "need"],
                )

    cuts = held.select("doc_id", "th", "text", "want").mapInArrow(cut, f"a bigint, piece binary, doc_id {id_type}, th bigint, at bigint, need boolean")
    hot = scratch.save(distinct.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") > block).select("a"), "hot")
    found = whole
    if not hot.isEmpty():
        cuts = scratch.save(cuts, "cuts")
        windows = scratch.save(_windows(cuts.join(hot, "a", "left_semi"), length, id_type), "windows")
        again = windows.groupBy("w").agg(F.count("*").alias("n")).filter("n > 1").select("w")
        found = found.unionByName(windows.filter("need").join(again, "w", "left_semi").select("doc_id", "th", F.col("s").alias("b"), (F.col("s") + length).alias("e")))
        cuts = cuts.join(hot, "a", "left_anti")
    dealt = cuts.repartition("a").sortWithinPartitions("a")
    return found.unionByName(_spans(dealt, length, id_type))


def _merged(spans: DataFrame) -> DataFrame:
    """The runs (doc_id, th, b, e) of each stretch of a text without those that touch; so a text's runs in a row are few for its length."""
    rows = spans.withColumn("_at", F.floor(F.col("b") / STRETCH))
    by = Window.partitionBy("doc_id", "th", "_at").orderBy("b", "e")
    rows = rows.withColumn("_reach", F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_run", F.count_if(F.col("_reach").isNull() | (F.col("b") > F.col("_reach"))).over(by))
    return rows.groupBy("doc_id", "th", "_at", "_run").agg(F.min("b").alias("b"), F.max("e").alias("e")).select("doc_id", "th", "b", "e")


def remove_repeats(docs: DataFrame, length: int = 200, block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept of every row of docs (doc_id, text, ...).

    kept holds the remaining bytes. Strings are judged on the input; overlaps and repeats within a text count; matches
    never cross texts. length: from 64 to 286 bytes. A null text counts as empty, an empty table gives an empty result, a very
    long text is cut into pieces like any other. Rows that repeat are texts of their own, so each is a repeat of the
    other; so are several texts under one doc_id, null included. Other columns are not looked at.
    """
    if not 2 * K <= length <= MOST:
        raise ValueError(f"a length from {2 * K} to {MOST} bytes")
    bound_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "suffix")
    docs = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.col("text").cast("string").alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    spans = _merged(repeated_spans(docs, length, block, scratch)).groupBy(F.col("doc_id").alias("_doc"), F.col("th").alias("_th")).agg(F.collect_list(F.struct("b", "e")).alias("spans"))  # no two of a stretch touch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                kept, at, n = [], 0, 0
                removed, end = 0, -1
                for b, e in sorted((x["b"], x["e"]) for x in spans.as_py() or ()):
                    if b > end:
                        n += 1
                        kept.append(data[at:b])
                        removed, end = removed + e - b, e
                    elif e > end:
                        removed, end = removed + e - end, e
                    at = end
                kept = b"".join([*kept, data[at:]])
                rows.append((len(data), removed, n, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = docs.join(spans, docs["doc_id"].eqNullSafe(F.col("_doc")) & (docs["th"] == F.col("_th")), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(run, f"doc_id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
