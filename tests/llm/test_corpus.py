"""WARC derivatives, mixing, sharding, the pipeline and the registered queries."""

import base64
import gzip
import hashlib
import itertools
import math
import re
import time
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tesserae.llm import kneser_ney, mixing, pii, piece, queries, sharding, simhash, warc

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


# WARC

PAGE = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script></head>
<body><nav><a href="/x?a=1&amp;b=2#f">Home</a> <a href='http://other.org/'>Other</a></nav><!-- hid <b>den</b> --><p>One&nbsp;two <b>three</b>&#33;<p>Four &lt;five&gt;</body></html>"""


def test_convert():
    text, facts = warc.convert(PAGE)
    assert text == "Home Other\nOne two three!\nFour <five>"
    assert facts == {"title": ["A & B"], "language": ["en"], "charset": ["utf-8"], "outlink": ["/x?a=1&b=2#f", "http://other.org/"]}
    assert warc.convert("")[0] == "" and warc.convert("no tags & all")[0] == "no tags & all"
    assert warc.convert("<p>open <b")[0] == "open <b" and warc.convert("<!-- never closed")[0] == ""


def test_broken_pages_are_read_once():
    assert warc.convert("<div <p>text")[0] == "text" and warc.convert("a<!doc")[0] == "a"
    n, began = 200_000, time.time()
    for page in ("<a href=x " * n, "<!" * n, "<script " * n, f"<a {'x' * n}>", f"a{chr(13) * n}b", "<p title='" * n):
        warc.convert(page)
    assert time.time() - began < 30  # each alone would take minutes if it were read again from every tag


def test_records_link_to_their_response(spark):
    pages = spark.createDataFrame([(1, "http://a.org/p/", PAGE, 5), (1, "http://a.org/p/", PAGE, 5), (2, None, None, 5), (None, "http://a.org/", "", 5)], "page_id bigint, url string, html string, block int")
    rows = warc.derive(warc.responses(pages, "2024-01-01T00:00:00Z")).collect()
    assert len(rows) == 8
    by = {(r.page_id, r.record_type): r for r in rows}
    meta, text = by[1, "metadata"], by[1, "conversion"]
    own = "sha1:" + base64.b32encode(hashlib.sha1(PAGE.encode()).digest()).decode()
    assert meta.refers_to == text.refers_to and len({meta.record_id, text.record_id, meta.refers_to}) == 3
    assert meta.source_payload_digest == text.source_payload_digest == own
    assert f"Content-Length: {len(PAGE.encode())}" in text.source_headers
    assert "outlink: http://a.org/x?a=1&b=2\r\n" in meta.block and "title: A & B\r\n" in meta.block
    for r in rows:
        assert r.block_digest == warc.digest(r.block.encode()) and r.content_length == len(r.block.encode())
    assert by[2, "conversion"].block == "" and by[2, "conversion"].target_uri == ""


def test_a_given_record_id_is_kept(spark):
    source = spark.createDataFrame([(1, "<urn:uuid:1>", "http://a.org/", None, "HTTP/1.1 200 OK\r\nServer: x\r\n", "<p>t")], "page_id bigint, record_id string, target_uri string, warc_date string, http_headers string, payload string")
    rows = warc.derive(source).collect()
    assert {r.refers_to for r in rows} == {"<urn:uuid:1>"} and all("Server: x" in r.source_headers for r in rows)


def test_records_as_bytes(spark):
    records = warc.derive(warc.responses(spark.read.parquet(f"{SF}/pages.parquet"), "2024-01-01T00:00:00Z"))
    want = {r.record_id: r for r in records.collect()}
    data = b"".join(r.data for r in warc.with_bytes(records).collect())
    found = list(warc.parse(data))
    assert len(found) == len(want) and len(gzip.decompress(data)) > len(data)
    for head, block in found:
        r = want[head["WARC-Record-ID"]]
        assert block == r.block.encode() and head["WARC-Refers-To"] == r.refers_to and head["WARC-Type"] == r.record_type
        assert base64.b64decode(head["WARC-Refers-To-HTTP-Headers"]).decode() == r.source_headers


def test_links_against_the_base():
    _, facts = warc.convert('<head><base href="/deep/"></head><a href="x">1</a><a href="x#top">2</a><a href="/deep/x">3</a><a href="http://[bad">4</a>')
    assert [x for x in warc.metadata(facts, "http://a.org/p", "").split("\r\n") if x.startswith("outlink")] == ["outlink: http://a.org/deep/x", "outlink: http://[bad"]


def test_responses_of_files(spark, tmp_path):
    """Responses in chunks, compressed and in other charsets, from files of gzip members; derived records refer to them."""

    def record(kind, rid, block, more=""):
        return gzip.compress(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{rid}>\r\nWARC-Target-URI: http://a.org/{rid}\r\nWARC-Date: 2024-05-01T00:00:00Z\r\n{more}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n")

    page, packed = "<title>é</title><p>Größe", gzip.compress("<p>zip".encode(), mtime=0)
    blocks = {
        "1": b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\n\r\n" + page.encode("latin-1"),
        "2": b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n" + b"%x\r\n" % 9 + packed[:9] + b"\r\n%x;x=1\r\n" % (len(packed) - 9) + packed[9:] + b"\r\n0\r\n\r\n",
        "3": "HTTP/1.1 200 OK\r\n\r\n<meta charset='windows-1252'><p>€".encode("cp1252"),
    }
    data = record("warcinfo", "0", b"x") + b"".join(record("response", k, b, "WARC-Payload-Digest: sha1:GIVEN\r\n" if k == "3" else "") for k, b in blocks.items())
    (tmp_path / "a.warc.gz").write_bytes(data)
    source = warc.read(spark, str(tmp_path))
    assert {r.page_id[-2]: r.payload for r in source.collect()} == {"1": page, "2": "<p>zip", "3": "<meta charset='windows-1252'><p>€"}
    rows = {(r.refers_to, r.record_type): r for r in warc.derive(source).collect()}
    assert len(rows) == 6 and rows["<urn:uuid:3>", "conversion"].source_payload_digest == "sha1:GIVEN"
    assert rows["<urn:uuid:2>", "conversion"].source_payload_digest == warc.digest(packed) and rows["<urn:uuid:1>", "conversion"].block == "Größe"
    head = next(warc.parse(warc.serialise(rows["<urn:uuid:1>", "metadata"])))[0]
    assert head["WARC-Refers-To-Target-URI"] == "http://a.org/1" and head["WARC-Refers-To-Date"] == "2024-05-01T00:00:00Z"


def test_no_pages(spark):
    assert warc.derive(warc.responses(spark.read.parquet(f"{SF}/pages.parquet").limit(0), "d")).collect() == []


# Mixing


def test_steps_are_the_distribution():
    for rate in (0.0001, 0.4, 1.0, 3.7, 40.0):
        want = [sum(math.exp(-rate + i * math.log(rate) - math.lgamma(i + 1)) for i in range(k + 1)) for k in range(12)]
        assert mixing.steps(rate)[:3] == pytest.approx(want[:3], rel=1e-12)
        assert all(a <= b for a, b in zip(mixing.steps(rate), mixing.steps(rate)[1:], strict=False))


def test_mix_meets_weights_and_shuffles(spark):
    docs = spark.createDataFrame([(i, "x" * 10, "big" if i % 3 else "small", i, 7.0) for i in range(6000)], "doc_id bigint, text string, source string, copy bigint, _u double")
    rows = mixing.mix(docs, {"big": 0.3}, 0.7).collect()
    share = Counter(r.source for r in rows)
    assert share["small"] / len(rows) == pytest.approx(0.7, abs=0.03) and len(rows) == pytest.approx(6000, rel=0.05)
    assert {r._u for r in rows} == {7.0}
    assert [r.mix_key for r in rows] == sorted(r.mix_key for r in rows)
    assert abs(sum(a.doc_id < b.doc_id for a, b in zip(rows, rows[1:], strict=False)) / len(rows) - 0.5) < 0.05
    again = mixing.mix(docs.repartition(7), {"big": 0.3}, 0.7).collect()
    assert rows == again
    copies = Counter(r.doc_id for r in rows if r.source == "small")
    n, rate = 2000, 0.7 * 6000 / 2000
    found = Counter(copies.get(i, 0) for i in range(0, 6000, 3))
    for k in range(5):
        assert found[k] / n == pytest.approx(math.exp(-rate) * rate**k / math.factorial(k), abs=0.04)


@pytest.mark.parametrize("most_sent", [mixing.MOST_SENT, 0])
def test_mix_odd(spark, most_sent):
    docs = spark.createDataFrame([(None, None, None), (1, "", "a"), (1, "text", "a"), (1, "text", "a"), (2, "more", None)], "doc_id bigint, text string, source string")
    rows = mixing.mix(docs, {"a": 0.5, "absent": 0.5}, 0.5, most_sent=most_sent).collect()
    assert len({(r.doc_id, r.text, r.copy) for r in rows}) == len(rows)
    assert mixing.mix(docs.limit(0), {"a": 1.0}, 0.0).collect() == []
    null = spark.createDataFrame([(None, f"text {i}", "a") for i in range(1000)], "doc_id bigint, text string, source string")
    found = Counter(r.text for r in mixing.mix(null, {"a": 1.0}, 0.0, most_sent=most_sent).collect())  # each by a draw of its own
    assert 900 < sum(found.values()) < 1100 and 580 < len(found) < 690
    equal = spark.createDataFrame([(7, "same", "a")] * 1000, "doc_id bigint, text string, source string")
    rows = mixing.mix(equal, {"a": 1.0}, 0.0, most_sent=most_sent).collect()
    assert 900 < len(rows) < 1100 and len({r.mix_key for r in rows}) == len(rows)
    blank = spark.createDataFrame([(i, " " if i % 2 else None, "b") for i in range(50)] + [(100 + i, "words", "a") for i in range(50)], "doc_id bigint, text string, source string")
    some = Counter(r.source for r in mixing.mix(blank.withColumn("text", F.when(F.col("source") == "b", F.lit("")).otherwise(F.col("text"))), {"a": 0.5, "b": 0.5}, 0.0).collect())
    assert some["b"] > 25 and some["a"] > 25


def test_mix_of_a_great_rate(spark):
    """A rate that no single draw could have: its copies have the mean and the variance of a Poisson distribution."""
    docs = spark.createDataFrame([(i, "x", "rare" if i < 40 else "rest") for i in range(80)], "doc_id bigint, text string, source string")
    copies = Counter(r.doc_id for r in mixing.mix(docs, {"rare": 1.0}, 0.0, total=40 * 900.0).collect())
    mean = sum(copies[i] for i in range(40)) / 40
    assert mean == pytest.approx(900, abs=20) and 0.4 < sum((copies[i] - mean) ** 2 for i in range(40)) / 39 / 900 < 2 and not any(i >= 40 for i in copies)


# Sharding


def plain_lookup(names, slots):
    """Shards in turn claim the next free slot of their whole permutation."""
    perms = []
    for s in names:
        d = hashlib.md5(s.encode()).digest()
        a, b = int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:], "big") % (slots - 1) + 1
        perms.append([(a + k * b) % slots for k in range(slots)])
    table, taken = {}, 0
    while taken < slots:
        for i, perm in enumerate(perms):
            free = next((x for x in perm if x not in table), None)
            if free is not None:
                table[free] = i
                taken += 1
    return [table[k] for k in range(slots)]


def test_lookup():
    names = [f"s{i}" for i in range(7)]
    assert sharding.lookup(names, 101).tolist() == plain_lookup(names, 101)
    assert sharding.lookup(["only"], 11).tolist() == [0] * 11
    a, b = sharding.lookup(queries.SHARDS), sharding.lookup(queries.SHARDS[:-1])
    assert max(Counter(a.tolist()).values()) - min(Counter(a.tolist()).values()) <= 1
    moved = sum(x != y for x, y in zip(a.tolist(), b.tolist(), strict=True) if x < 63)
    assert moved < 0.15 * len(a)
    for bad in (["x", "x"], []):
        with pytest.raises(ValueError):
            sharding.lookup(bad, 11)
    with pytest.raises(ValueError):
        sharding.lookup(["x"], 12)


def test_place(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", "old"), (1, "b", "old"), (None, "c", "old"), (7, "d", "old")], "doc_id bigint, text string, shard string")
    rows = sharding.place(docs, ["x", "y", "z"], ["doc_id"], 101).collect()
    table = plain_lookup(["x", "y", "z"], 101)
    assert len(rows) == 4 and len({r.shard for r in rows if r.doc_id == 1}) == 1
    for r in rows:
        h = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:13], 16)
        assert r.slot == h % 101 and r.shard == "xyz"[table[r.slot]]
    assert sharding.place(docs.limit(0), ["x"], ["doc_id"], 11).collect() == []
    sharding.write(sharding.place(docs, ["x", "y", "z"], ["doc_id"], 101), str(tmp_path / "out"), 2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


# Queries and the pipeline


def test_sql_agrees(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, SF)
        cols = sorted(df.columns)
        rel = con.execute(sql)
        names = [x[0] for x in rel.description]
        assert sorted(names) == cols
        want = Counter(tuple(r[names.index(c)] for c in cols) for r in rel.fetchall())
        assert Counter(tuple(r[c] for c in cols) for r in df.collect()) == want, name


def test_clashing_columns_are_kept(spark):
    names = "_u _n _slot _bucket _steps _doc _head _h _own h fp kind canon attempt surrogate least root node".split()
    docs = spark.createDataFrame([(1, "call (310) 555-1234 now, or never again", "a", *names), (2, "other words stand in this one here", "a", *names)], f"doc_id bigint, text string, source string, {', '.join(f'{n} string' for n in names)}")
    for made in (mixing.mix(docs, {"a": 1.0}, 0.0, total=500.0), sharding.place(docs, ["x", "y"], ["doc_id"], 11), simhash.keep_one(docs), pii.pseudonymise(docs, b"k"), pii.pseudonymise(docs, b"k", -1)):
        rows = made.collect()
        assert rows and all(r[n] == n for r in rows for n in names)


def test_all_are_registered():
    names = set(entry.queries())
    assert {f.split("_")[0] for f in queries.queries()} == {f"op{k}" for k in range(1, 11)}
    assert set(queries.queries()) | {"pipeline"} <= names


def plain_groups(texts):
    """By id the least id of its group: texts are linked if their sets of five-word shingles have a resemblance of 0.8."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids, groups = sorted(sets), {i: i for i in sets}
    for a, b in itertools.combinations(ids, 2):
        if groups[a] != groups[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            lo, hi = sorted((groups[a], groups[b]))
            groups = {k: lo if v == hi else v for k, v in groups.items()}
    return groups


def plain_pipeline(spark):
    """The stages without Spark, from the classifier's scores on."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    verdicts = {r.doc_id: r.kept for r in kneser_ney.judged(docs, labels).collect()}
    rows = {r.doc_id: r for r in docs.collect() if verdicts[r.doc_id]}
    kept = sorted(set(plain_groups({i: r.text for i, r in rows.items()}).values()))
    attempts: dict = {}
    own = sorted({(k, c) for i in kept for _, _, k, c in pii.detect(rows[i].text)})
    while True:
        drawn = {e: pii.draw(*e, attempts.get(e, 0), b"surrogates of the test tables") for e in own}
        owners: dict = {}
        for e in own:
            owners.setdefault((e[0], drawn[e]), []).append(e)
        again = {e for es in owners.values() for e in es[1:]} | {e for e in own if (e[0], drawn[e]) in own}
        if not again:
            break
        for e in again:
            attempts[e] = attempts.get(e, 0) + 1
    texts = {i: pii.replace(rows[i].text, b"surrogates of the test tables", attempts)[0] for i in kept}
    bucket = lambda s: s if s in queries.WEIGHTS else None
    sizes = Counter()
    for i in kept:
        sizes[bucket(rows[i].source)] += len(texts[i])
    share = {**queries.WEIGHTS, None: queries.OTHER}
    mass = sum(w for s, w in share.items() if sizes[s])
    out = Counter()
    with open(queries.TOKENIZER, "rb") as f:
        codec = piece.Codec(f.read())
    for i in kept:
        s = bucket(rows[i].source)
        u = int(hashlib.md5(f"{queries.SEED}:{i}:{hashlib.md5(texts[i].encode()).hexdigest()}:0".encode()).hexdigest()[:13], 16) / (1 << 52)
        n = sum(c <= u for c in mixing.steps(share[s] / mass * sum(sizes.values()) / sizes[s]))
        out[i, tuple(codec.encode(texts[i]))] += n
    return +out


def test_pipeline(spark):
    spark.conf.set(queries.KEY, "surrogates of the test tables")
    got = Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == plain_pipeline(spark)


def test_pipeline_odd(spark):
    """Nulls in all columns, repeated rows, blank and very long texts, and empty tables, through every stage."""
    odd = [(None, None, None, None, None), (1, "", "en", "src0", 0), (1, "a text that stands here twice and is kept once by the stage for copies", "en", "src0", 70), (1, "a text that stands here twice and is kept once by the stage for copies", "en", "src0", 70), (2, " \n", None, "src1", 2), (3, "long " * 60_000, "xx", None, None)]
    docs = spark.createDataFrame(odd, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for rows in (docs, docs.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            rows = stage(spark, rows, SF)
            assert k == len(corpus_pipeline.STAGES) - 1 or rows.columns == docs.columns
        found = rows.collect()
    assert found == []


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert dict(stage(spark, docs, SF).dtypes) == dict(docs.dtypes)
