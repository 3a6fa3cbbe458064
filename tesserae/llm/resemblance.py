"""Groups of near copies by the resemblance (Jaccard) of their texts' sets of shingles: SimHash links, then a wider signature.

The links of the texts' SimHash fingerprints (simhash.links: deletion variants of the bits) come first, each verified on the
two whole sets; what they connect isn't compared again. At a resemblance of 0.8 the 64 bits differ in about ten places, more
than any cut into segments that are still selective can bridge (the README has figures). So a second signature of SLOTS
MinHash values, of which two texts share each with a chance of their resemblance, is indexed in the same way: it is cut into
few segments, so that one of them differs in at most one slot; each segment's variants, one slot left out, are index keys;
equal keys give candidates, and every link is verified. A pair at 0.8 shares no key with a chance of one in 5,000, fewer above it.

Texts with equal sets are one node. A key's nodes are compared with its least node first; those that this links are one component. Then only nodes of different
components are compared: a key's nodes outside its largest component are dealt out in blocks, and all its nodes pass by each
block, in one task, a node at a time. So no pairs are written but those that link, no group is held in memory beyond a
block, and a group of near copies, which its least node links, isn't compared with itself. Keys with the same nodes are one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, components

#: Links need a resemblance of LEAST[0] / LEAST[1].
LEAST = (4, 5)
#: Segments of a signature, and slots in each.
SEGMENTS, IN_SEGMENT = 10, 7
SLOTS = SEGMENTS * IN_SEGMENT
#: Nodes of a block, and nodes that pass by a block in one task.
IN_BLOCK, PASSING = 512, 50_000
#: Shingles under all functions at a time, and words whose hashes a worker keeps.
STRIP, CACHE = 1 << 10, 400_000

_FIXED = np.random.Generator(np.random.PCG64(5))
_MASKS = _FIXED.integers(0, 1 << 32, (SLOTS, 1), np.uint32)
_FACTORS = _FIXED.integers(0, 1 << 32, (SLOTS, 1), np.uint32) | np.uint32(1)
_PLACES = _FIXED.integers(0, 1 << 63, (SEGMENTS, IN_SEGMENT), np.uint64) | np.uint64(1)
_SPREAD = _FIXED.integers(0, 1 << 63, 7, np.uint64) | np.uint64(1)
_WILD = _FIXED.integers(0, 1 << 63, (SEGMENTS, IN_SEGMENT), np.uint64)


class _Words(dict):
    """Hashes of words, kept while there are at most CACHE."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        made = xxhash.xxh64_intdigest(word, 42)
        if len(word) <= 64:
            self[word] = made
        return made


_KNOWN = _Words()


def shingles(text: str | None, width: int) -> np.ndarray:
    """The distinct hashes of a text's shingles in order; words and shingles are those of simhash.fingerprint. A shingle's hash is mixed from its words'."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    one = np.fromiter(map(_KNOWN.__getitem__, words), np.uint64, len(words))
    n, out = max(1, len(words) - width + 1), None
    for k in range(min(width, len(words))):
        part = (one[k : k + n] ^ np.uint64(k + 1)) * _SPREAD[k % len(_SPREAD)]
        part ^= part >> np.uint64(31)
        out = part if out is None else out * _SPREAD[-1] + part
    out ^= out >> np.uint64(29)
    out *= _SPREAD[-2]
    out ^= out >> np.uint64(32)
    return np.unique(out)


def keys(found: np.ndarray) -> np.ndarray:
    """The keys of a set of shingles as signed longs, segment by segment: one for each slot left out. None of an empty set."""
    if not len(found):
        return np.empty(0, np.int64)
    high, least = (found >> np.uint64(32)).astype(np.uint32), np.full(SLOTS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(high), STRIP):
        mixed = high[k : k + STRIP] ^ _MASKS
        mixed *= _FACTORS
        np.minimum(least, mixed.min(axis=1), out=least)
    slots = least.reshape(SEGMENTS, IN_SEGMENT).astype(np.uint64) * _PLACES
    return (slots.sum(axis=1, dtype=np.uint64)[:, None] - slots + _WILD).ravel().view(np.int64)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets, in order, reach the resemblance."""
    return Block([(0, 0, a)]).links(1, b) == [0]


class Block:
    """Sets (node, root, set) that others pass by: all their shingles in order, and whose each is."""

    def __init__(self, members: list[tuple[int, int, np.ndarray]]):
        self.members, self.sizes = members, np.array([len(x) for _, _, x in members], np.int64)
        flat, owner = np.concatenate([x for _, _, x in members]), np.repeat(np.arange(len(members)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], owner[order]

    def links(self, root: int, other: np.ndarray) -> list[int]:
        """The places of the members that reach the resemblance with another set, of another root than its."""
        part, whole = LEAST
        first, last = np.searchsorted(self.flat, other), np.searchsorted(self.flat, other, side="right")
        met = last > first
        runs = last[met] - first[met]
        if not len(runs):
            return []
        at = np.repeat(first[met] - np.concatenate(([0], np.cumsum(runs)[:-1])), runs) + np.arange(runs.sum())
        both = np.bincount(self.owner[at], minlength=len(self.members))
        return [k for k in np.flatnonzero(whole * both >= part * (self.sizes + len(other) - both)).tolist() if self.members[k][1] != root]


def _signed(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), 42)).view(np.int64)) if len(found) else 0


def nodes(docs: DataFrame, width: int, text_hash: Column, fingerprint: Callable[[str | None, int], int]) -> DataFrame:
    """(s, least, size, fp, keys) of the distinct sets s: least is (none, doc_id, h) of the least row that has it, h its text's hash, fp its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets, sizes, fps, made = [], [], [], []
            for text in b.column(2).to_pylist():
                found = shingles(text, width)
                sets.append(_signed(found))
                sizes.append(len(found))
                fps.append(fingerprint(text, width))
                made.append(keys(found))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(sets, pa.int64()), pa.array(sizes, pa.int32()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(made, pa.list_(pa.int64()))], ["doc_id", "h", "s", "size", "fp", "keys"])

    bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", text_hash.alias("h"), F.col("text").cast("string"))
    rows = rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h bigint, s bigint, size int, fp bigint, keys array<bigint>")
    made = rows.groupBy("s").agg(F.min(F.struct(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h").alias("least"), "size", "fp", "keys")).alias("x"))
    return made.select("s", "x.least", "x.size", "x.fp", "x.keys")


def sets(wanted: DataFrame, docs: DataFrame, width: int, text_hash: Column) -> DataFrame:
    """(s, set) of the nodes wanted (s, id, own), by the row whose text they take: their shingles' hashes in order, 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([shingles(t, width).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["s", "set"])

    rows = docs.select("doc_id", text_hash.alias("h"), F.col("text").cast("string").alias("text"))
    texts = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("own"))).select("s", "text")
    return texts.mapInArrow(run, "s bigint, set binary").dropDuplicates(["s"])


def verified(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets, known by (s, set), reach the resemblance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [alike(_read(x), _read(y)) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    side = lambda name: known.select(F.col("s").alias(name), F.col("set").alias(f"set_{name}"))
    return pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "set_u", "set_v").mapInArrow(run, "u bigint, v bigint")


def _read(value: pa.BinaryScalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint64)


def across(live: DataFrame, known: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (u, v) that connect the nodes of each key (key, s, size, root) across components just as all links in it do."""
    by_root = live.groupBy("key", "root").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("s")).alias("mark"), F.bit_xor(F.xxhash64("s", F.lit(1))).alias("other"))
    keys = by_root.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root"))["root"].alias("main"), F.max("n").alias("most"), F.count("*").alias("parts"), F.bit_xor("mark").alias("mark"), F.bit_xor("other").alias("other"))
    keys = keys.filter("parts > 1").groupBy("n", "main", "most", "mark", "other").agg(F.min("key").alias("key"))  # of keys with the same nodes one
    blocks, passes = F.ceil((F.col("n") - F.col("most")) / IN_BLOCK).cast("int"), F.ceil(F.col("n") / PASSING).cast("int")
    keys = scratch.save(keys.select("key", "main", blocks.alias("blocks"), passes.alias("passes")), "keys")
    rows = live.join(keys, "key")
    own = F.when(F.col("root") != F.col("main"), F.pmod(F.xxhash64("s"), F.col("blocks")).cast("int"))
    turn = F.pmod(F.xxhash64("s", F.lit(2)), F.col("passes")).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    held = rows.filter("root <> main").select("key", own.alias("block"), F.explode(every(F.col("passes"))).alias("turn"), F.lit(0).alias("side"), "s", "root")
    passing = rows.select("key", F.explode(every(F.col("blocks"))).alias("block"), turn.alias("turn"), F.lit(1).alias("side"), "s", "root")
    dealt = held.unionByName(passing).join(known, "s").select("key", "block", "turn", "side", "s", "root", "set").repartition("key", "block", "turn").sortWithinPartitions("key", "block", "turn", "side", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, members, block, up = None, [], None, {}

        def top(x: int) -> int:
            while up.get(x, x) != x:
                x = up[x]
            return x

        for b in batches:
            out = []
            for place, side, s, root, data in zip(zip(*(b.column(k).to_pylist() for k in range(3)), strict=True), *(b.column(k).to_pylist() for k in (3, 4, 5)), b.column(6), strict=True):
                if place != last:
                    last, members, block, up = place, [], None, {}
                if not side:
                    members.append((s, root, _read(data).copy()))
                    continue
                block = block or Block(members)
                for k in block.links(root, _read(data)):
                    node, its = block.members[k][:2]
                    x, y = top(root), top(its)
                    if x != y:  # what is linked already needs no other link
                        up[y] = x
                        out.append((s, node))
            cols = list(zip(*out, strict=True)) if out else [[], []]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], ["u", "v"])

    return dealt.mapInArrow(run, "u bigint, v bigint")


def roots(made: DataFrame, found: DataFrame, docs: DataFrame, width: int, text_hash: Column, scratch: Scratch) -> DataFrame:
    """(s, root) of the nodes that are linked to another one; found are the pairs (u, v) of nodes that their fingerprints link."""
    part, whole = LEAST
    index = made.select("s", "size", F.explode("keys").alias("key"))
    met = scratch.save(index.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "met")
    live = scratch.save(index.join(met, "key").select("key", "s", "size", (F.col("n") > 2).alias("more")), "live")
    heads = live.groupBy("key").agg(F.min(F.struct("s", "size")).alias("head"))
    near = F.least("size", "head.size") * whole >= F.greatest("size", "head.size") * part
    pairs = live.join(heads, "key").filter((F.col("s") != F.col("head.s")) & near).select(F.col("head.s").alias("u"), F.col("s").alias("v"))
    pairs = scratch.save(pairs.distinct(), "pairs")
    wanted = pairs.unionByName(found).select(F.explode(F.array("u", "v")).alias("s")).union(live.filter("more").select("s")).distinct()
    wanted = scratch.save(made.join(wanted, "s").select("s", F.col("least.doc_id").alias("id"), F.col("least.h").alias("own")), "wanted")
    known = scratch.save(sets(wanted, docs, width, text_hash), "sets")
    first = scratch.save(verified(found, known), "first")
    before = scratch.save(components(first, scratch), "before")
    root = lambda name: before.select(F.col("node").alias(name), F.col("root").alias(f"root_{name}"))
    apart = pairs.join(root("u"), "u", "left").join(root("v"), "v", "left").filter("root_u IS NULL OR root_v IS NULL OR root_u <> root_v").select("u", "v")
    links = scratch.save(first.unionByName(verified(scratch.save(apart, "apart"), known)), "links")
    placed = scratch.save(components(links, scratch), "placed")
    rest = live.filter("more").select("key", "s").join(placed.withColumnRenamed("node", "s"), "s", "left").select("key", "s", F.coalesce("root", "s").alias("root"))
    more = scratch.save(across(scratch.save(rest, "rest"), known, scratch), "across")
    if not more.isEmpty():
        placed = scratch.save(components(links.unionByName(more), scratch), "roots")
    scratch.drop("met", "live", "pairs", "apart", "wanted", "sets", "rest", "keys")
    return placed.select(F.col("node").alias("s"), "root")
