"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

At each position the automaton's output links give every piece that ends there; each relaxes the best score at the
position. Characters that no piece covers fall back to byte pieces, or to the unknown piece where the model has none.

A unigram model's scores are log probabilities and are used as they are. A BPE model's are only the order of its merges:
its pieces score as a Zipf law gives for their ranks, -log(2 + rank).

Blanks become U+2581, and one is put before the text, as the model's trainer did; a U+2581 of the text itself is written
in byte pieces, so decoding gives back exactly the text. As no piece has U+2581 after another character, every best path
has a boundary before such a one: the path of a text is that of its words, each of which is solved once per worker while
it stays in a bounded cache.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

MARK = "▁"
#: A byte piece scores this much less than the worst piece.
BYTE_PENALTY = 10.0
#: Words whose paths a worker keeps, and characters from which a path is found in packed numbers.
CACHE, LONG = 400_000, 1 << 14


def read_model(data: bytes, settings: dict[int, object] | None = None) -> list[tuple[str, float, int]]:
    """(piece, score, type) of each id of a .model file; types: 1 normal, 2 unknown, 3 control, 4 user defined, 6 byte.

    settings gets the fields of the model's normaliser: 2 the map of characters, 3 whether a blank is put before a text,
    4 whether blanks are collapsed.
    """
    settings = {} if settings is None else settings

    def fields(view: bytes):
        at = 0

        def varint():
            nonlocal at
            value = shift = 0
            while True:
                b = view[at]
                at += 1
                value |= (b & 127) << shift
                shift += 7
                if b < 128:
                    return value

        while at < len(view):
            key = varint()
            kind = key & 7
            if kind == 0:
                value = varint()
            elif kind == 2:
                size = varint()
                value = view[at : at + size]
                at += size
            else:
                size = 8 if kind == 1 else 4
                value = view[at : at + size]
                at += size
            yield key >> 3, value

    pieces, merges = [], False
    for number, value in fields(data):
        if number == 2:
            merges = dict(fields(value)).get(3) == 2
        if number == 3:
            settings.update(fields(value))
        if number == 1:
            own = dict(fields(value))
            pieces.append((own.get(1, b"").decode(), float(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0]), own.get(3, 1)))
    return [(p, -math.log(2.0 - s), k) if merges and k == 1 else (p, s, k) for p, s, k in pieces]


class Codec:
    """Encodes and decodes with the pieces of one model."""

    def __init__(self, data: bytes):
        settings: dict[int, object] = {}
        pieces = read_model(data, settings)
        if settings.get(2):
            raise ValueError("a model that maps characters: texts must be normalised before")
        #: What is put before a text. Blanks aren't collapsed, also where the model's trainer did: a text must decode as it was.
        self.lead = MARK if settings.get(3, 1) else ""
        forced = sorted((p for p, _, k in pieces if k == 4 and p), key=len, reverse=True)
        self.forced = re.compile("|".join(map(re.escape, forced))) if forced else None
        self.ids = {p: i for i, (p, _, k) in enumerate(pieces) if k == 4}
        self.pieces = [p for p, _, _ in pieces]
        self.unknown = next((i for i, (_, _, k) in enumerate(pieces) if k == 2), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == 6}
        self.automaton = ahocorasick.Automaton()
        scores = [s for _, s, k in pieces if k == 1]
        for i, (p, s, k) in enumerate(pieces):
            if k == 1 and p:
                self.automaton.add_word(p, (i, len(p), s))
        self.automaton.make_automaton()
        self.byte_score = min(scores, default=0.0) - BYTE_PENALTY
        self.by_word = all(MARK not in p.lstrip(MARK) for p, _, k in pieces if k == 1)
        self.word = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        #: Characters that are pieces: no byte piece can be better for them.
        self.singles = {p for p, _, k in pieces if k == 1 and len(p) == 1}
        #: What each id stands for.
        self.plain = [bytes([int(p[3:5], 16)]) if k == 6 else b"" if k == 3 else p.replace(MARK, " ").encode() for p, _, k in pieces]
        self.known = _Paths(self)

    def _fallback(self, char: str) -> list[int]:
        """The byte pieces of a character, or the unknown piece."""
        data = char.encode("utf-8", "surrogatepass")
        return [self.bytes[b] for b in data] if all(b in self.bytes for b in data) else [self.unknown]

    def path(self, text: str, literal: frozenset[int] | set[int] = frozenset()) -> list[int]:
        """The ids of the best path over text; of equal scores the one whose last piece is longest. literal: positions of U+2581 that stand for themselves."""
        n, bare, singles = len(text), self.byte_score, self.singles if not literal else ()
        best, start, ids = [0.0] + [float("-inf")] * n, range(-1, n), [-1] * (n + 1)
        if n > LONG:  # 16 bytes a character, where lists take about 100
            best, start, ids = array("d", best), array("i", start), array("i", ids)
        else:
            start = list(start)
        at = 0
        for end, (i, size, s) in self.automaton.iter(text):
            while at < end:  # scores up to at are final: the character after it may go in byte pieces
                if text[at] not in singles:
                    t = best[at] + bare * len(text[at].encode("utf-8", "surrogatepass"))
                    if t > best[at + 1]:
                        best[at + 1], start[at + 1], ids[at + 1] = t, at, -1
                at += 1
            first = end + 1 - size
            if literal and any(k in literal for k in range(first, end + 1)):
                continue
            s += best[first]
            if s > best[end + 1] or s == best[end + 1] and first < start[end + 1]:
                best[end + 1], start[end + 1], ids[end + 1] = s, first, i
        while at < n:
            if text[at] not in singles:
                t = best[at] + bare * len(text[at].encode("utf-8", "surrogatepass"))
                if t > best[at + 1]:
                    best[at + 1], start[at + 1], ids[at + 1] = t, at, -1
            at += 1
        out = array("i")
        while n:
            out.extend([ids[n]] if ids[n] >= 0 else self._fallback(text[start[n]])[::-1])
            n = start[n]
        return out[::-1].tolist()

    def encode(self, text: str) -> list[int]:
        """The ids of a text: user-defined pieces where they stand, the longest first, and the best paths between them."""
        if not text:
            return []
        if not self.forced:
            return self._plain(text, self.lead)
        out, at, lead = [], 0, self.lead
        marked = lead + text.replace(" ", MARK) if MARK not in text else None
        if marked is None:  # its own U+2581: pieces with one don't stand for it
            marked, own = lead + text.replace(" ", MARK), {k + len(lead) for k, c in enumerate(text) if c == MARK}
        else:
            own = set()
        for m in self.forced.finditer(marked):
            if own and not own.isdisjoint(range(m.start(), m.end())):
                continue
            out += self.path(marked[at : m.start()], {k - at for k in own if at <= k < m.start()}) + [self.ids[m[0]]]
            at = m.end()
        return out + self.path(marked[at:], {k - at for k in own if k >= at})

    def _plain(self, text: str, lead: str) -> list[int]:
        if MARK in text:  # its own U+2581, apart from those for blanks
            return self.path(lead + text.replace(" ", MARK), {k + len(lead) for k, c in enumerate(text) if c == MARK})
        if not self.by_word or not lead:
            return self.path(lead + text.replace(" ", MARK))
        if "  " in text or text[0] == " " or text[-1] == " ":
            words = [w[1:] for w in self.word.findall(MARK + text.replace(" ", MARK))]
        else:
            words = text.split(" ")
        return list(chain.from_iterable(map(self.known.__getitem__, words)))

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.plain.__getitem__, ids)).decode("utf-8", "surrogatepass")
        return text[1:] if self.lead and text[:1] == " " else text


class _Paths(dict):
    """The paths of words, a U+2581 before each, kept while there are at most CACHE."""

    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = tuple(self.codec.path(MARK + word))  # the garbage collector leaves tuples of numbers alone
        if len(self) >= CACHE:
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip of every row of docs (doc_id, text, ...).

    round_trip says whether decoding the ids gave the text. A null text counts as empty and has no ids; repeated rows
    stay; an empty table gives an empty result; very long texts and words are encoded whole. Of paths of one score the one
    whose last piece is longest is taken. Other columns are not looked at. model: the bytes of a .model file, whose size is
    the vocabulary's.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            sizes, same, flat = [0], [], []
            for text in batch.column(1).to_pylist():
                ids = codec.encode(text or "")
                same.append(codec.decode(ids) == (text or ""))
                flat.append(np.array(ids, np.int32))
                sizes.append(sizes[-1] + len(ids))
            lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(flat) if flat else [], pa.int32()))
            yield pa.record_batch([batch.column(0), pa.array(np.diff(sizes), pa.int64()), lists, pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids", "round_trip"])

    bound_batches(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids array<int>, round_trip boolean")


def decode(tokens: DataFrame, model: bytes) -> DataFrame:
    """doc_id and text of rows (doc_id, ids, ...); null ids give an empty text."""
    shared = tokens.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([codec.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    bound_batches(tokens.sparkSession)
    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, text string")
