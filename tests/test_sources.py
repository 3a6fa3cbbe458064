"""Layout JSON of any depth, PDF files, the text engine, page images, threads, models behind HTTP, logs."""

import http.server
import json
import logging
import threading
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae import logs
from tesserae.operators import connectors, retrieval, store
from tesserae.plans import lifecycle, sessions
from tesserae.sources import image, layout, pdf


def layout_texts(spark, *kids):
    docs = spark.createDataFrame([(1, json.dumps({"kids": [{"page number": 1, "bounding box": [0, 0, 9, 9], **k} for k in kids]}))], "doc_id int, json string")
    return [e.text for r in layout.layout_pages(docs).collect() for e in r.elements]


def test_lists_of_any_depth(spark):
    deep = None
    for k in range(600, 0, -1):
        deep = [{"content": f"level{k}", "list items": deep or []}]
    assert layout_texts(spark, {"type": "list", "list items": deep}) == ["\n".join(f"level{k}" for k in range(1, 601))]
    node = {"content": "top", "kids": [{"content": "one", "list items": [{"content": "two", "kids": [{"content": "three"}]}]}, {"content": " "}]}
    assert layout.flat_list(node) == "top\none\ntwo\nthree" and layout.flat_list(node, True) == "top\none\none\ntwo\ntwo\nthree"
    assert layout_texts(spark, {"type": "table", "rows": [{"cells": [{"list items": [{"content": "a", "kids": [{"content": "b", "kids": [{"content": "c"}]}]}]}]}]}) == ["| a b c |\n| --- |"]
    assert layout_texts(spark, {"type": "table", "kids": [{"content": "no", "kids": [{"content": "rows"}]}]}) == ["no\nrows"]
    assert layout_texts(spark, {"type": "table", "kids": [{"type": "Row", "kids": [{"type": "cell", "text": "x"}, {"type": "other"}]}]}) == ["| x |\n| --- |"]


def test_layout_that_does_not_parse(spark):
    docs = spark.createDataFrame([(1, "{"), (2, None), (3, '{"kids": [1]}'), (4, '{"kids": [{"content": "fine", "bounding box": [1, 2, 3, 4]}]}')], "doc_id int, json string")
    rows = {r.doc_id: r for r in layout.layout_rows(docs).collect()}
    assert sorted(rows) == [1, 3, 4] and rows[1].error and rows[3].error and rows[4].error is None
    assert [r.doc_id for r in layout.layout_pages(docs).collect()] == [4]


def test_references_in_html(spark):
    pages = spark.createDataFrame([(1, "<body><p>A&nbsp;B &#39;x&#39; &eacute; &#x41; &unknown; &amp;lt;</p></body>")], "page_id int, html string")
    assert [r.text for r in layout.html_elements(pages).collect()] == ["A\xa0B 'x' é A &unknown; &lt;"]


def test_references_without_a_semicolon_are_text(spark):
    pages = spark.createDataFrame([(1, "<body><p>the&amp;&amp;&amp</p><p>a &copy b &#39 c &notit; &ampx; d</p></body>")], "page_id int, html string")
    assert [r.text for r in layout.html_elements(pages).orderBy("elem_no").collect()] == ["the&&&amp", "a &copy b &#39 c &notit; &ampx; d"]


def a_pdf(streams, packed=True):
    """A PDF file with a page for each content stream, objects of the page tree in an object stream if packed."""
    body = zlib.compress if packed else (lambda b: b)
    objects = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/MediaBox[0 0 595 842]/Resources<</Font<</F1 3 0 R>>>>/Kids[%s]>>" % b" ".join(b"%d 0 R" % (10 + 2 * k) for k in range(len(streams))), 3: b"<</Type/Font/ToUnicode 4 0 R>>"}
    objects |= {10 + 2 * k: b"<</Type/Page/Parent 2 0 R/Contents %d 0 R>>" % (11 + 2 * k) for k in range(len(streams))}
    held = {4: b"2 beginbfchar <01> <0041> <02> <00E900E8> endbfchar 1 beginbfrange <20> <7E> <0020> endbfrange"} | {11 + 2 * k: s for k, s in enumerate(streams)}
    out = [b"%PDF-1.5"]
    if packed:
        heads, bodies = [], b""
        for n, o in objects.items():
            heads.append(b"%d %d" % (n, len(bodies)))
            bodies += o + b" "
        first = b" ".join(heads) + b" "
        held[99] = first + bodies
    else:
        out += [b"%d 0 obj %s endobj" % x for x in objects.items()]
    for n, raw in held.items():
        data = body(raw)
        head = b"/Type/ObjStm/N %d/First %d" % (len(objects), len(first)) if n == 99 else b""
        out.append(b"%d 0 obj <<%s/Length %d%s>> stream\r\n%s\r\nendstream endobj" % (n, head, len(data), b"/Filter/FlateDecode" if packed else b"", data))
    return b"\n".join(out)


@pytest.mark.parametrize("packed", [True, False])
def test_pdf_blocks(packed):
    first = rb"BT /F1 10 Tf 72 700 Td (Two \(2\)) Tj 0 -12 Td [(li) -300 (nes)] TJ ET BT /F1 20 Tf 1 0 0 1 72 500 Tm <0102> Tj T* ET q Q (x) pop"
    data = a_pdf([first, b"BT /F1 10 Tf 10 10 Td (ab) Tj ET", b"% a scanned page"], packed)
    got = list(pdf.blocks(data))
    assert [(n, [t for _, t in found]) for n, found in got] == [(1, ["Two (2) li nes", "Aéè"]), (2, ["ab"]), (3, [])]
    assert got[0][1][0][0] == [72.0, 132.0, 107.0, 156.0]
    rows = layout.pdf_blocks(data)
    assert [(r[0], r[3], r[5]) for r in rows] == [(1, "Two (2) li nes", 0.9), (1, "Aéè", 0.9)]
    by_model = layout.layout_blocks(lambda page, found: [*reversed(found), ([0, 0, 1, 1], " ")])
    assert [(r[0], r[3], r[5]) for r in by_model(data)] == [(1, "Aéè", 0.88), (1, "Two (2) li nes", 0.88), (2, "ab", 0.88)]
    with pytest.raises(RuntimeError):
        layout.layout_blocks()(data)


def test_bad_pdf_files():
    for data in (b"", b"text", b"%PDF-1.4 nothing", b"%PDF-1.4 trailer <</Encrypt 5 0 R>>"):
        with pytest.raises(ValueError):
            list(pdf.blocks(data))
    began = time.time()
    assert [t for _, t in next(iter(pdf.blocks(a_pdf([b"BT /F1 9 Tf " + b"(w) Tj 0 -10 Td " * 20_000 + b"ET"]))))[1]] == [" ".join(["w"] * 20_000)]
    assert time.time() - began < 20


def test_files_by_engine(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("erster\n\nzweiter Absatz".encode("utf-16"))
    (tmp_path / "b.html").write_bytes(b"<html><script>no</script><p>one &amp; two</p><p>three</p></html>")
    (tmp_path / "c.pdf").write_bytes(a_pdf([b"BT /F1 10 Tf 72 700 Td (page one) Tj ET", b"", b"BT /F1 10 Tf 72 700 Td (page three) Tj ET"]))
    (tmp_path / "d.txt").write_bytes(b"caf\xe9\fnext")
    (tmp_path / "e.pdf").write_bytes(b"%PDF-1.4 broken")
    found = layout.engine_documents(layout.files(spark, str(tmp_path)))
    assert [r.doc_id[-5:] for r in found.filter("error is not null").collect()] == ["e.pdf"]
    got = sorted((r.doc_id.rsplit("/")[-1], r.page_number, r.text, r.confidence) for r in layout.engine_elements(found).collect())
    assert got == [("a.txt", 1, "erster", 0.92), ("a.txt", 1, "zweiter Absatz", 0.92), ("b.html", 1, "one & two", 0.92), ("b.html", 1, "three", 0.92), ("c.pdf", 1, "page one", 0.92), ("c.pdf", 3, "page three", 0.92), ("d.txt", 1, "café", 0.92), ("d.txt", 2, "next", 0.92)]


def test_images(spark):
    blank = np.full((40, 60, 3), 255, np.uint8)
    made = image.framed(blank, [[10, 10, 30, 20], [1, 2], None, [-5, -5, 900, 900]], 1.0, (255, 0, 0), 1)
    assert (blank == 255).all() and tuple(made[10, 15]) == (255, 0, 0) == tuple(made[0, 0]) and tuple(made[15, 15]) == (255, 255, 255)
    assert (image.decode(image.encode(made)) == made).all() and image.overlaid(None, []) is None
    with pytest.raises(ValueError):
        image.decode(b"no image")
    rows = [(d, 1, f"/i/{d}.png", [("text", "t", [10.0, 10.0, 100.0, 30.0], 0.9)]) for d in (1, 2)]
    pages = spark.createDataFrame(rows, f"doc_id int, page_number int, image_path string, elements array<{layout.ELEMENT}>")
    drawn = image.drawn(pages, dpi=72)
    pixels = image.decode(bytes(drawn.first().png))
    assert pixels.shape == (842, 595, 3) and tuple(pixels[10, 50]) == image.FILL
    boxes = spark.createDataFrame([(1, 1, [[200.0, 200.0, 300.0, 260.0]])], "doc_id int, page_number int, bboxes array<array<double>>")
    over = {r.doc_id: image.decode(bytes(r.png)) for r in image.overlays(drawn, boxes, 72).collect()}
    assert tuple(over[1][200, 250]) == image.LINE and (over[2] == pixels).all()


def test_png_filters():
    """Rows stored as differences to the left, above, the mean and the nearest of three are read back."""
    rng = np.random.default_rng(1)
    want = rng.integers(0, 256, (5, 7, 3), np.uint8)
    rows, above = b"", np.zeros(21, int)
    for k, row in enumerate(want.reshape(5, 21).astype(int)):
        left, corner = np.concatenate([[0] * 3, row[:-3]]), np.concatenate([[0] * 3, above[:-3]])
        guess = left + above - corner
        dist = np.stack([abs(guess - left), abs(guess - above), abs(guess - corner)])
        base = [np.zeros(21, int), left, above, (left + above) // 2, np.choose(dist.argmin(axis=0), [left, above, corner])][k]
        rows += bytes([k]) + ((row - base) % 256).astype(np.uint8).tobytes()
        above = row
    data = image.encode(want)
    at = data.index(b"IDAT") - 4
    body = zlib.compress(rows)
    made = data[:at] + len(body).to_bytes(4) + b"IDAT" + body + zlib.crc32(b"IDAT" + body).to_bytes(4) + data[data.index(b"IEND") - 4 :]
    assert (image.decode(made) == want).all()


def test_threads_outlive_a_session(spark, tmp_path):
    path = str(tmp_path / "threads")
    model = lambda log: log.groupBy("conv_id").agg(F.count("*").cast("string").alias("text")).withColumn("tool_calls", F.lit(0))
    ask = lambda t, q: sessions.converse(t, spark.createDataFrame([("a", q)], "conv_id string, text string"), model, lambda c: c).first().answer
    assert ask(sessions.Threads(spark, "table", path), "one") == "1"
    again = sessions.Threads(spark, "table", path)
    assert again.kind == "table" and ask(again, "two") == "3"
    assert [(r.turn, r.role, r.text) for r in again.log().orderBy("turn").collect()] == [(0, "user", "one"), (1, "assistant", "1"), (2, "user", "two"), (3, "assistant", "3")]
    assert sessions.Threads(spark).kind == "memory"
    (tmp_path / "file").write_text("x")
    assert sessions.Threads(spark, "table", str(tmp_path / "file" / "below")).kind == "memory"
    with pytest.raises(ValueError):
        sessions.Threads(spark, "other")


@pytest.mark.parametrize("kind", ["memory", "table"])
def test_threads_keep_messages_off_the_driver(spark, tmp_path, monkeypatch, kind):
    """Three threads that call a tool 0, 1 and 2 times, with nothing fetched or sent by the driver; the model runs once a step."""
    runs = spark.sparkContext.accumulator(0)

    def once(x):
        runs.add(1)
        return x

    counted = F.udf(once, "string").asNondeterministic()

    def model(log):
        said = log.groupBy("conv_id").agg(F.count_if(F.col("role") == "tool").alias("n"))
        return said.select("conv_id", counted(F.concat(F.lit("after "), F.col("n").cast("string"))).alias("text"), (F.col("n") < F.col("conv_id").cast("int")).cast("int").alias("tool_calls"))

    def refused(self, *args, **kwargs):
        raise AssertionError("messages at the driver")

    asked = spark.createDataFrame([(str(k), "why?") for k in range(3)], "conv_id string, text string")
    threads = sessions.Threads(spark, kind, str(tmp_path / "threads"))
    for name in ("toArrow", "toPandas"):
        monkeypatch.setattr(type(asked), name, refused)
    made = sessions.converse(threads, asked, model, lambda calls: calls)
    monkeypatch.undo()
    assert {r.conv_id: r.answer for r in made.collect()} == {"0": "after 0", "1": "after 1", "2": "after 2"}
    assert runs.value == 3 + 2 + 1 and threads.log().count() == 3 + 6 + 3
    assert [(r.turn, r.role, r.text) for r in threads.log().filter("conv_id = '1'").orderBy("turn").collect()] == [(0, "user", "why?"), (1, "assistant", "after 0"), (2, "tool", "after 0"), (3, "assistant", "after 1")]


def test_commands():
    assert sessions.command(" ", "t") == ("skip", "t") and sessions.command("Quit", "t") == ("leave", "t") and sessions.command("why?", "t") == ("ask", "t")
    kind, thread = sessions.command("/new", "t")
    assert kind == "new" and len(thread) == 36 and "no document" in sessions.status(None) and "<b>" not in sessions.status("<b>", 3, 4, 5, True)


def test_active_type(spark, tmp_path):
    path = str(tmp_path / "active")
    assert sessions.load_active(spark, path)[0] == "fallback"
    sessions.save_active(spark, path, "contract", "Vertrag A")
    kind, name, domains = sessions.load_active(spark, path)
    assert (kind, name) == ("contract", "Vertrag A") and "payment" in domains
    sessions.save_active(spark, path, "gone", "x")
    assert sessions.load_active(spark, path)[0] == "fallback"


@pytest.fixture(scope="module")
def service():
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if self.path == "/embed":
                made = {"embeddings": [[float(len(t)), 1.0] for t in body["input"]]}
            elif self.path == "/rerank":
                made = {"results": [{"index": k, "relevance_score": float(len(t))} for k, t in enumerate(body["documents"])][: 1 if body["query"] == "short" else None]}
            else:
                made = {"response": body["prompt"].upper()}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(made).encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_models_behind_http(spark, service):
    gone = "http://127.0.0.1:9"
    assert connectors.reachable(service) and not connectors.reachable(gone)
    rows = spark.createDataFrame([(1, "abc"), (2, "de")], "id int, text string")
    assert [list(r.embedding) for r in store.embed(rows, embedder=connectors.embedder(service, "m")).orderBy("id").collect()] == [[3.0, 1.0], [2.0, 1.0]]
    assert {len(r.embedding) for r in store.embed(rows, embedder=connectors.embedder(gone, "m")).collect()} == {64}
    asked = spark.createDataFrame([(1, "q"), (2, "short")], "query_id int, query string")
    hits = spark.createDataFrame([(q, d, r, t) for q in (1, 2) for d, r, t in ((10, 1, "a"), (11, 2, "bbb"), (12, 3, "cc"))], "query_id int, doc_id int, rank int, text string")
    order = lambda url: [r.doc_id for r in sorted(retrieval.rerank(hits, asked, 3, connectors.relevance(url, "m")).collect(), key=lambda r: (r.query_id, r["rank"]))]
    assert order(service) == [11, 12, 10, 10, 11, 12] and order(gone) == [10, 11, 12] * 2
    said = lambda url: [r.x for r in rows.orderBy("id").select(connectors.replies(url, "m", 5)(F.col("text")).alias("x")).collect()]
    assert said(service) == ["ABC", "DE"] and said(gone) == ["", ""]


def test_vectors_in_blocks(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(300)] + [(900, None), (901, [0.0] * 5), (902, [1.0])]
    table = spark.createDataFrame(vectors, "vec_id int, embedding array<float>").repartition(5)
    asked = table.filter("vec_id % 50 = 0 and vec_id < 300").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    rows = {(r.query_id, r["rank"]): r.vec_id for r in retrieval.vector_hits(table, asked, 7, block=2).collect()}
    assert rows == {(r.query_id, r["rank"]): r.vec_id for r in retrieval.vector_hits(table, asked, 7).collect()}
    unit = {r.vec_id: np.array(r.embedding) / np.linalg.norm(r.embedding) for r in table.filter("vec_id < 300").collect()}
    for q in range(0, 300, 50):
        best = sorted(unit, key=lambda i: (-round(float(unit[q] @ unit[i]), 12), i))[:7]
        assert [rows[q, k + 1] for k in range(7)] == best
    assert retrieval.vector_hits(table, asked.limit(0), 7).collect() == []


def test_written_postings_answer_alike(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"common word{i % 7} {'rare ' * (i % 3)}") for i in range(40)] + [(40, None)], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "rare word3 rare"), (2, "common"), (3, "absent")], "query_id int, query string")
    retrieval.write_postings(retrieval.postings(docs), str(tmp_path / "p"), 8)
    a = sorted((r.query_id, r.doc_id, round(r.score, 9)) for r in retrieval.bm25_asked(retrieval.read_postings(spark, str(tmp_path / "p")), asked, parts=8).collect())
    assert a == sorted((r.query_id, r.doc_id, round(r.score, 9)) for r in retrieval.bm25_scores(docs, asked).collect()) and {x[0] for x in a} == {1, 2}


def test_a_document_without_chunks_any_more(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = lambda *ids: spark.createDataFrame([(i, 0) for i in ids], "doc_id int, chunk_id int")
    store.upsert(spark, path, rows(1, 2, 3), 4)
    store.upsert(spark, path, rows(3), 4, rows(1, 3))
    assert sorted(r.doc_id for r in store.load(spark, path).collect()) == [2, 3]
    store.upsert(spark, path, rows(9).limit(0), 4, rows(2, 3))
    assert store.load(spark, path) is None and [p.name for p in tmp_path.iterdir()] == ["store"]


def test_answers_without_a_graph(spark, tmp_path):
    rows = [(1, 1, k, "text", f"paragraph {k} with words enough to be a chunk by itself, number {k}", [0.0, 0.0, 100.0, 20.0], 0.9, "") for k in range(3)]
    elements = spark.createDataFrame(rows, "doc_id int, page_number int, elem_no int, type string, text string, bbox array<double>, confidence double, image_path string")
    path = str(tmp_path / "index")
    lifecycle.write(lifecycle.index(elements, 60), path)
    store.clear(spark, f"{path}/edges")
    asked = lifecycle.asked(spark.createDataFrame([(1, "paragraph")], "query_id int, query string"))
    assert lifecycle.search_term(lifecycle.load(spark, path), asked).first().content.startswith("FOUND SECTIONS")


def test_logs(tmp_path):
    before = logging.getLogger().level
    made = logs.configure(str(tmp_path))
    try:
        logging.getLogger("tesserae.x").debug("own detail")
        logging.getLogger("other").info("of another")
        logging.getLogger("py4j.java_gateway").info("noise")
        for h in logs.configure(str(tmp_path)):
            h.flush()
        assert "own detail" in (tmp_path / "own.log").read_text() and "another" not in (tmp_path / "own.log").read_text()
        text = (tmp_path / "all.log").read_text()
        assert "of another" in text and "noise" not in text and "own detail" not in text
    finally:
        for h in [h for h in logging.getLogger().handlers if getattr(h, "tesserae", False)]:
            logging.getLogger().removeHandler(h)
            h.close()
        logging.getLogger().setLevel(before)
    assert len(made) == 3
