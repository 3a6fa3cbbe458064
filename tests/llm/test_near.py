"""Fingerprints, near-duplicates and repeated substrings, held against plain versions."""

import hashlib
import re
import struct
from collections import Counter

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae.llm import resemblance, simhash, sketch, suffix
from tesserae.llm.common import Scratch, components

SF = "/root/testdata/sf0.001"
ODD = [(1, "a" * 1000), (1, "a" * 1000), (None, None), (2, ""), (3, "xyz" * 100), (4, "q" + "abc def " * 40), (1, "abc def " * 40), (5, "é" * 150), (6, "z" * 199), (7, "z" * 200), (8, "z" * 201), (9, "one two"), (10, " \n\t ")]


def with_clash(spark, rows):
    """Rows with columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 1, "x", 2, None) for r in rows], "doc_id bigint, text string, th int, fp string, a int, sketch string")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(ids, links):
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_near_duplicates(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    fps = {i: plain_fingerprint(t) for i, t in rows}
    ids = sorted(fps)
    want = plain_components(ids, [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 2])
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (fps[i], want[i]) for i in ids}


def test_near_duplicates_odd(spark):
    got = simhash.near_duplicates(with_clash(spark, ODD)).collect()
    assert len(got) == len(ODD)
    by = {(r.doc_id, r.fp): r.component_id for r in got}
    assert by[2, 0] == by[10, 0] == by[None, 0] == 2  # blank texts link like any other
    assert simhash.near_duplicates(with_clash(spark, ODD).limit(0)).collect() == []


def test_links_in_a_crowded_ball(spark):
    """Many fingerprints that share a segment: linked exactly, without pairing them all."""
    base = 0x0123456789ABCDEF
    fps = [base ^ (1 << i) for i in range(0, 40)] + [base ^ (7 << i) for i in range(0, 60, 3)] + [base ^ (0x1F << 20), 0, 3, 31, -1, -4]
    fps = sorted({f - (1 << 64) if f >> 63 and f > 0 else f for f in fps})
    found = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp bigint"), Scratch(spark, "test")).collect()
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2
    assert all(near(r.u, r.v) for r in found)
    want = plain_components(fps, [(a, b) for a in fps for b in fps if a < b and near(a, b)])
    assert plain_components(fps, [(r.u, r.v) for r in found]) == want


def test_keep_one(spark):
    docs = spark.createDataFrame([(3, "a b c d e f g"), (1, "a b c d e f g"), (2, "something else that is there for good"), (1, "a b c d e f g")], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [1, 2]
    odd = [(None, "one text of its own"), (None, "one text of its own"), (None, "another that stands alone"), (None, "a b c d e f g"), (1, "a b c d e f g"), (1, "not at all like its namesake"), (None, None), (5, " ")]
    kept = simhash.keep_one(spark.createDataFrame(odd, "doc_id bigint, text string")).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter({odd[0], odd[2], odd[4], odd[5], odd[7]})


def test_keep_one_by_resemblance(spark):
    """All near copies at a resemblance of 0.8, most of them more than two bits apart, against all pairs of sets."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    words = {r.doc_id: lowered(r.text).split() for r in docs.collect()}
    sets = {i: {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    ids = sorted(sets)
    near = [(a, b) for a in ids for b in ids if a < b and 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b])) and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert (2, 56) in near and (simhash.fingerprint(" ".join(words[2]), 5) ^ simhash.fingerprint(" ".join(words[56]), 5)).bit_count() > 2
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(set(plain_components(ids, near).values()))


def test_keep_one_links_by_fingerprints(spark, monkeypatch):
    """Without the wider signature texts at two or fewer differing bits are linked, by way of others too, unless their sets differ."""
    nodes = resemblance.nodes
    monkeypatch.setattr(resemblance, "nodes", lambda *given: nodes(*given).withColumn("keys", F.expr("cast(array() as array<bigint>)")))
    base = [f"w{i}" for i in range(3000)]
    rows = [(k, " ".join(base[:-k] + [f"x{k}_{i}" for i in range(k)] if k else base)) for k in range(4)]
    rows += [(8, "p q r s t " * 400 + " ".join(f"y{i}" for i in range(10))), (9, "p q r s t " * 400 + " ".join(f"z{i}" for i in range(10)))]
    rows += [(10, " ".join(base[:1500])), (10, " ".join(base[:1500]))]
    fps = {i: simhash.fingerprint(t, 5) for i, t in rows}
    near = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    assert set(plain_components(range(4), [(a, b) for a, b in near if b < 4]).values()) == {0} and (8, 9) in near
    assert sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()) == [0, 8, 9, 10]


def test_keep_one_of_a_large_group(spark, monkeypatch):
    """Many copies of one text that share keys are linked by way of few, and a text below the bound stays."""
    monkeypatch.setattr(resemblance, "IN_BLOCK", 4)
    monkeypatch.setattr(resemblance, "PASSING", 7)
    base = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join(base[:k] + [f"x{k}"] + base[k + 1 :])) for k in range(100)] + [(100, " ".join(base[:140] + [f"y{i}" for i in range(60)]))]
    assert sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()) == [0, 100]


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (300, 100), (7, 7)] + [(500, k) for k in range(501, 540)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u bigint, v bigint"), Scratch(spark, "test")).collect()}
    want = plain_components({x for e in links for x in e}, links)
    want.pop(7, None) if 7 not in got else None
    assert got == {k: v for k, v in want.items() if k in got}
    assert len(got) == 61 + 4 + 40
    assert components(spark.createDataFrame([], "u bigint, v bigint"), Scratch(spark, "test")).collect() == []


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_sketch(text):
    m = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.findall(r"[^\x20\x09-\x0D]+", lowered(text))]

    def chain(xs, h):
        for x in xs:
            h = signed(xxhash.xxh64_intdigest(struct.pack("<q", x), h & (2**64 - 1)))
        return h

    few = len(m)
    for x in m:
        few = chain([few, x], 42)
    hashes = [chain(m[i : i + 5], 42) for i in range(len(m) - 4)] if len(m) >= 5 else [few] if m else []
    low = sorted({h for h in hashes if h < sketch.limit(sketch.SCALE)})
    return low or ([min(hashes)] if hashes else [])


@pytest.mark.parametrize("rows", [None, [(i, f"w{i % 3} b c d e f g h") for i in range(40)], [(5, "one")], ODD])
def test_sketches(spark, rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet") if rows is None else with_clash(spark, rows)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0], r[1]))
    want = Counter()
    show = lambda s: "".join(f"{h & (2**64 - 1):016x}" for h in s)
    for k, (i, t) in enumerate(rows):
        after, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = (set(plain_sketch(x)) for x in (t, edited, after))
        share = lambda x, y: 1.0 if not x and not y else len(x & y) / len(x) if x else 0.0
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), show(sorted(a)), show(sorted(b)), round(share(a, b), 9), round(share(a, c), 9)] += 1
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in sketch.fingerprint(docs).collect())
    assert got == want


def test_sketch_merges(spark):
    from pyspark.sql import functions as F

    words = [f"w{i}" for i in range(300)]
    df = spark.createDataFrame([(" ".join(words[:200]), " ".join(words[150:]), " ".join(words[:200]) + " | " + " ".join(words[150:]))], "a string, b string, c string")
    a, b = sketch.sketch(F.col("a")), sketch.sketch(F.col("b"))
    r = df.select(sketch.merged(a, b).alias("m"), a.alias("a"), b.alias("b"), sketch.containment(a, b).alias("share")).first()
    assert r.m == sorted(set(r.a) | set(r.b))
    assert 0 < r.share < 0.6


def test_sketch_empty(spark):
    assert sketch.fingerprint(with_clash(spark, ODD).limit(0)).collect() == []


def test_sketch_of_string_ids(spark):
    """Ids of any type, and one id with very many texts."""
    rows = [(f"id{i % 50:02d}" if i % 3 else None, f"text {i} " + "w " * (i % 9)) for i in range(600)]
    got = sketch.fingerprint(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    rows.sort(key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    cut = lambda t, after: t[: len(t) - len(t) // 2] + after[: len(t) // 2]
    want = Counter((i, len(t), hashlib.sha256(cut(t, rows[(k + 1) % 600][1]).encode()).hexdigest()) for k, (i, t) in enumerate(rows))
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want


def test_sketch_is_native(spark):
    plan = sketch.fingerprint(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def plain_removal(rows, length=200):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(b[k : k + length] for b in data for k in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, data, strict=True):
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def removal(docs, **how):
    return Counter(tuple(r)[:5] for r in suffix.remove_repeats(docs, **how).collect())


@pytest.mark.parametrize("block", [suffix.BLOCK, 3])
def test_removal(spark, block):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert removal(docs, block=block) == plain_removal([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("block", [suffix.BLOCK, 1])
def test_removal_odd(spark, block):
    assert removal(with_clash(spark, ODD), block=block) == plain_removal(ODD)


def test_removal_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK", 300)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert removal(docs) == plain_removal([(r.doc_id, r.text) for r in docs.collect()])


def test_removal_of_one_letter(spark):
    """A long text of one letter: a piece a byte, whose runs are merged before they meet in a row."""
    got = suffix.remove_repeats(spark.createDataFrame([(1, "a" * 300_000), (2, "b" * 400 + "c" * 150)], "doc_id bigint, text string")).collect()
    assert sorted(tuple(r)[:4] for r in got) == [(1, 300_000, 300_000, 1), (2, 550, 400, 1)]


def test_removal_of_other_lengths(spark):
    docs = spark.createDataFrame(ODD, "doc_id bigint, text string")
    for length in (64, 286):
        assert removal(docs, length=length) == plain_removal(ODD, length)
    for length in (63, 287):
        with pytest.raises(ValueError):
            suffix.remove_repeats(docs, length)


def test_removal_empty(spark):
    assert suffix.remove_repeats(with_clash(spark, ODD).limit(0)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=6, max_size=14), min_size=1, max_size=8), st.integers(0, 3))
def test_order_finds_repeats(texts, offset):
    """The column-wise order against all windows at one column."""
    strings = [t.encode() for t in texts]
    found = suffix.repeated(strings, [offset] * len(strings), 4)
    for column in range(found.shape[0]):
        seen = Counter(s[column : column + 4] for s in strings if column + 4 <= len(s))
        for i, s in enumerate(strings):
            assert found[column, i] == (column + 4 <= len(s) and seen[s[column : column + 4]] > 1)
