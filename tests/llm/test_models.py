"""Classifier, surrogates, rules and tokens, held against plain versions, held-out labels and round trips."""

import math
import re
import time
from collections import Counter

import pyarrow.parquet as pq
import pytest

from tesserae.llm import cascade, kneser_ney, pii, piece, queries
from tesserae.llm.common import Scratch

SF = "/root/testdata/sf0.001"
SF1 = "/root/testdata/sf0.01"


def with_clash(spark, rows):
    return spark.createDataFrame([(*r, "en", "s", 1, 2, True) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars int, n_words int, kept boolean")


ODD = [(1, None), (2, ""), (3, " \n"), (1, "Again and again."), (1, "Again and again."), (None, "word"), (4, "x" * 50_000), (5, "ab " * 30_000)]


# The classifier


def plain_probability(counts, order, gram_counts):
    """Interpolated modified Kneser-Ney from a word list's n-grams, written anew from its definition."""
    follows = Counter(g[1:] for g in counts if len(g) > 1)
    adjusted = {g: n if len(g) == order or (len(g) > 1 and g[0] == " ") else follows.get(g, n) for g, n in counts.items()}
    symbols = sum(len(g) == 1 for g in counts)
    reduced = {}
    for k in range(1, order + 1):
        t = [sum(c == i and len(g) == k for g, c in adjusted.items()) for i in (1, 2, 3, 4)]
        if all(t):
            y = t[0] / (t[0] + 2 * t[1])
            d = [1 - 2 * y * t[1] / t[0], 2 - 3 * y * t[2] / t[1], 3 - 4 * y * t[3] / t[2]]
        else:
            d = [0.5, 1.0, 1.5]
        reduced[k] = [min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)]

    def p(gram):
        if not gram:
            return 1 / (symbols + 256)
        h, d = gram[:-1], reduced[len(gram)] if len(gram) in reduced else None
        own = {g: c for g, c in adjusted.items() if len(g) == len(gram) and g[:-1] == h}
        if not own:
            return p(gram[1:])
        total = sum(own.values())
        weight = sum(d[min(c, 3) - 1] for c in own.values()) / total
        c = own.get(gram, 0)
        return (max(c - d[min(c, 3) - 1], 0) / total if c else 0) + weight * p(gram[1:])

    return p


def test_model_is_kneser_ney(spark):
    texts = spark.createDataFrame([("the cat sat on the mat then that cat sang a song and the rat ran",), ("these cats sit there",)], "text string")
    raw = kneser_ney.grams(texts, 3)
    counts = {r.gram: r.n for r in raw.collect()}
    assert counts[" th"] == 7 and counts["the"] == 6 and counts[" "] == 20 and " t" in counts
    counted = kneser_ney.counts(raw, 3)
    reduced = kneser_ney.discounts(counted)
    alike, log_unseen = kneser_ney.unseen(counted, reduced)
    table = kneser_ney.probabilities(counted, reduced, alike, Scratch(spark, "model"), 3)
    model = kneser_ney.Model(kneser_ney.sent(table, log_unseen, 3))
    p = plain_probability(counts, 3, counts)
    for word in ("the", "cat", "tha", "zzz", "thing", "x", "sangs"):
        s = f" {word} "
        want = sum(math.log(p(s[max(0, e - 3) : e])) for e in range(2, len(s) + 1))
        assert model.words(["a", word, "the"])[1] == pytest.approx(want, abs=1e-9)
    known = sorted({c for g in counts for c in g})
    assert sum(p(" t" + c) for c in known) == pytest.approx(1 - p(" t~") * 256, abs=1e-9)  # what is left is for unseen ones


def test_large_model_is_joined(spark):
    """Scores by the sharded join are those of the model that is sent, also of very long words and repeated rows."""
    docs = with_clash(spark, [*ODD, (6, "y" * (kneser_ney.BLOCK + 9) + " the end"), *((100 + i, f"some plain words of text number {i} naïve Ω") for i in range(30))])
    labels = spark.createDataFrame([(100 + i, 1, 0) for i in range(30)], "doc_id bigint, quality int, toxic int")
    model = kneser_ney.train(docs, labels, Scratch(spark, "large"))
    found = [sorted((r.doc_id or 0, r.n_words, r.n_scored, r.nll) for r in kneser_ney.scores(docs, *model, most_sent=n).collect()) for n in (0, 10**6)]
    assert len(found[0]) == len(found[1]) == docs.count()
    for joined, sent in zip(*found, strict=True):
        assert joined[:3] == sent[:3] and joined[3] == pytest.approx(sent[3], rel=1e-9)


def test_model_grows_with_the_trusted_text(spark):
    """Every n-gram of every trusted document with an even hash is in the model, from whole texts."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model, _ = kneser_ney.train(docs, labels, Scratch(spark, "grows"))
    ids = {r.doc_id for r in kneser_ney.half(kneser_ney.trusted(labels), False).collect()}
    want = {s[b:e] for r in docs.collect() if r.doc_id in ids for w in kneser_ney.split(r.text or "") for s in [f" {w} "] for e in range(2, len(s) + 1) for b in range(max(0, e - 5), e)}
    assert {r.gram for r in model.filter("p is not null").collect()} == want


def test_classifier_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF1}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id: r.kept for r in kneser_ney.judged(docs, labels).collect()}
    rows = labels.collect()
    good, bad = [r.doc_id for r in rows if r.quality == 1], [r.doc_id for r in rows if r.quality == 0]
    assert len(kept) == docs.count()
    assert sum(kept[i] for i in good) >= 0.98 * len(good)
    assert sum(not kept[i] for i in bad) >= 0.8 * len(bad)


def test_classifier_odd(spark):
    docs = with_clash(spark, [*ODD, *((100 + i, f"some plain words of text number {i}") for i in range(60))])
    labels = spark.createDataFrame([(100 + i, 1, 0) for i in range(50)] + [(100, 1, 0), (1, None, None), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = kneser_ney.judged(docs, labels).collect()
    assert len(got) == len(ODD) + 60
    assert all(r.kept and r.perplexity is None for r in got if r.doc_id in (2, 3))
    assert all(r.kept for r in got if (r.doc_id or 0) >= 100)
    assert kneser_ney.judged(docs.limit(0), labels).collect() == []
    assert all(r.kept for r in kneser_ney.judged(docs, labels.limit(0)).collect())


def test_split_is_by_ascii_blanks():
    for text in ("a b\tc\x0bd", "a\xa0b c", " x y\x1c z", "", "  "):
        assert kneser_ney.split(text) == re.findall(r"[^\x20\x09-\x0D]+", text)


# Surrogates

TEXT = "Mr. John Smith met Frau Anna Müller and Mrs Smith. Иван Петров; call (310) 555-1234 or 310-555-1234, +49 30 1234567, DE89 3704 0044 0532 0130 00, 192.168.1.5, A.b@c.de, 4111 1111 1111 1111, token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"."


def test_kinds():
    kinds = Counter(k for _, _, k, _ in pii.detect(TEXT))
    assert kinds == Counter({"PHONE": 3, "NAME_S": 4, "NAME_M": 2, "NAME_F": 1, "IBAN": 1, "IP": 1, "EMAIL": 1, "CARD": 1, "SECRET": 1})
    assert pii.detect("Apache License, Version 2.0. See 10.5 and 1.2.3.4.5 in 2024-01-01.") == []


def test_surrogates_of_planted_people(spark):
    """Texts with people at known places, held against the result alone: nobody is left, all of one person agree, others differ, scripts stay."""
    texts = {
        1: "Contact Priya Sharma or Wei Zhang before noon. Ask Sharma first; Zhang is away.",
        2: "Dr. Maria Lopez wrote. Maria Lopez signed. Lopez agreed.",
        3: "Dr Alex Doe called.",
        4: "Mr Alex Doe called.",
        5: "Κος Παπαδόπουλος and again Παπαδόπουλος.",
        6: "王小明先生 came; 王小明 left.",
        7: "Dear Priya Sharma, hello.",
        8: "The contract and the Contact page name nobody at all.",
    }
    got = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), b"key").collect()}
    for word in "Priya Sharma Wei Zhang Maria Lopez Alex Doe Παπαδόπουλος 王小明".split():
        assert not any(word in t for t in got.values()), word
    one = re.fullmatch(r"Contact (\w+) (\w+) or (\w+) (\w+) before noon\. Ask (\w+) first; (\w+) is away\.", got[1]).groups()
    assert one[1] == one[4] and one[3] == one[5] and len(set(one)) == 4
    two = re.fullmatch(r"Dr\. (\w+) (\w+) wrote\. (\w+) (\w+) signed\. (\w+) agreed\.", got[2]).groups()
    assert two[:2] == two[2:4] and two[1] == two[4]
    assert got[3].split()[1:] == got[4].split()[1:]
    assert len(set(re.findall("[Α-Ωα-ωά-ώ]+", got[5].split(" ", 1)[1]))) == 1
    han = re.findall("[\u4e00-\u9fff]{2,4}", got[6].replace("先生", " "))
    assert len(han) == 2 and han[0] == han[1]
    assert got[7] == f"Dear {one[0]} {one[1]}, hello." and got[8] == texts[8]


def test_full_spaces_end(spark):
    """All hosts of a network and many short addresses: every one gets a surrogate of its own."""
    own = [f"192.168.{a}.{b}" for a in range(10) for b in range(10)] + [f"{a}@{b}.co" for a in "aeioubcdfgh" for b in "aeioubcdfgh"]
    got = [r.text for r in pii.pseudonymise(spark.createDataFrame([(i, f"at {x} now") for i, x in enumerate(own)], "doc_id bigint, text string"), b"key").collect()]
    drawn = [t.split(" ")[1] for t in got]
    assert len(set(drawn)) == len(own) and not set(drawn) & set(own)


def test_entities_of_a_very_long_text_take_linear_time():
    line, n, began = "Mr Hans Bergmann wrote to a.b@c.org from 192.168.1.20. ", 20_000, time.time()
    assert len(pii.detect(line * n)) == n * len(pii.detect(line))
    assert time.time() - began < 30  # minutes if each entity were held against all before it


def test_surrogates_keep_type_and_coreference():
    made, n = pii.replace(TEXT, b"k", {})
    assert n == 15
    assert [k for _, _, k, _ in pii.detect(made) if not k.startswith("NAME")] == [k for _, _, k, _ in pii.detect(TEXT) if not k.startswith("NAME")]
    got = {(k, c) for _, _, k, c in pii.detect(made)}
    assert not got & {(k, c) for _, _, k, c in pii.detect(TEXT)}
    own = re.search(r"Mr\. (\w+) (\w+) met Frau \w+ \w+ and Mrs (\w+)\. (\w+) (\w+);", made)
    assert own[2] == own[3] != "Smith"  # one family name
    assert re.fullmatch("[А-Яа-я]+", own[4]) and re.fullmatch("[А-Яа-я]+", own[5])  # in its script
    phones = re.search(r"call \((\d{3})\) (\d{3})-(\d{4}) or (\d{3})-(\d{3})-(\d{4}), \+\d\d \d\d \d{7},", made)
    assert phones.groups()[:3] == phones.groups()[3:]
    card = re.search(r", (\d{4} \d{4} \d{4} \d{4}), token", made)[1].replace(" ", "")
    assert pii.luhn(card) and card[0] == "4"
    iban = re.search(r"DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d", made)[0].replace(" ", "")
    assert pii._iban_check(iban[:2], iban[4:]) == iban[2:4]
    assert "192.168." in made and "@" in made and made.count(".de,") == 1
    assert pii.replace(TEXT, b"k", {})[0] == made != pii.replace(TEXT, b"other", {})[0]


@pytest.mark.parametrize("most_sent", [pii.MOST_SENT, 0])
def test_surrogates_stay_distinct(spark, most_sent):
    """So many addresses of one short format that they collide: different ones get different surrogates, none of them another's."""
    hosts = [f"{a}.{b}.1.1" for a in range(1, 10) for b in range(1, 10)]
    rows = [(i, f"host {h} and {h}") for i, h in enumerate(hosts[:24])] + [(100, None), (101, ""), (102, "no one here")]
    docs = with_clash(spark, rows)
    got = {r.doc_id: r for r in pii.pseudonymise(docs, b"key", most_sent).collect()}
    made = {}
    for i, h in enumerate(hosts[:24]):
        first, second = re.fullmatch(r"host (\S+) and (\S+)", got[i].text).groups()
        assert first == second and got[i].n_entities == 2
        made[h] = first
    assert len(set(made.values())) == len(made)
    assert not set(made.values()) & set(made)
    assert got[100].text is None and got[101].text == "" and got[102].text == "no one here"
    assert pii.pseudonymise(docs.limit(0), b"key").collect() == []


def test_full_formats_are_left(spark):
    """Formats of which the texts have every value, and values that no draw can change."""
    assert pii.detect("Password: ________ password: ............ token = --------") == []
    own = [("IP", f"192.168.{a}.{b}") for a in range(1, 10) for b in range(1, 10)] + [("EMAIL", f"{a}@{b}.de") for a in "aeiou" for b in "aeiou"] + [("SECRET", f"-------{a}") for a in "aeiou"]
    rows = [(i, f"Password: ________ and token = {x}" if kind == "SECRET" else f"at {x} now") for i, (kind, x) in enumerate(own)]
    made = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id bigint, text string"), b"key").collect()}
    assert all(made[i].startswith(t.rsplit(x, 1)[0]) for (i, t), (_, x) in zip(rows, own, strict=True))
    drawn = [made[i][len(t.rsplit(x, 1)[0]) :].split(" ")[0] for (i, t), (_, x) in zip(rows, own, strict=True)]
    assert len(set(drawn)) == len(own) and not set(drawn) & {x for _, x in own}
    assert all(x.startswith(("192.168.", "10.")) for x, (kind, _) in zip(drawn, own, strict=True) if kind == "IP")


def test_later_draws_keep_kind():
    for kind, canon, mention in (("PHONE", "1234567", "+1 23 45 67"), ("PHONE", "3105551234", "(310) 555-1234"), ("SSN", "012345678", "012-34-5678"), ("IBAN", "DE89370400440532013000", "DE89 3704 0044 0532 0130 00"), ("IP", "10.1.1.1", "10.1.1.1")):
        drawn = [pii.draw(kind, canon, k, b"k") for k in range(40)]
        assert len(set(drawn)) == 40 and len({pii.render(mention, kind, x) for x in drawn}) == 40
        assert kind != "IBAN" or all(pii._iban_check(x[:2], x[4:]) == x[2:4] for x in drawn)


def test_no_personal_data_is_left(spark):
    docs = spark.read.parquet(f"{SF1}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    got = pii.pseudonymise(docs, b"key").collect()
    own = {(k, c) for t in before.values() for _, _, k, c in pii.detect(t)}
    assert len(got) == len(before) and own
    for r in got:
        assert not own & {(k, c) for _, _, k, c in pii.detect(r.text)}
        if not r.n_entities:
            assert r.text == before[r.doc_id]


# Rules


def plain_measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {p for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_rules(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + ODD
    got = Counter(tuple(r) for r in cascade.judge(with_clash(spark, rows)).collect())
    want = Counter()
    for i, t in rows:
        m = plain_measures(t)
        base = m[0] < 20 or 100 * m[4] > 30 * m[0]
        want[(i, *m, base, not base and not any(f(cascade.Text(t)) for f in cascade.RULES.values()))] += 1
    assert got == want
    assert cascade.judge(with_clash(spark, ODD).limit(0)).collect() == []


def test_rules_are_ordered_by_rejection_per_cost(spark):
    tried = {"slow": lambda t: time.sleep(0.002) or True, "quick": lambda t: True, "never": lambda t: False}
    words = " ".join(f"w{i}" for i in range(30))
    docs = with_clash(spark, [(None, words) for _ in range(20)])
    assert cascade.ordered(*cascade.estimate(docs, tried, 20)) == ["quick", "never", "slow"]  # nothing is left for the slow one
    assert sum(cascade.estimate(docs.union(docs).union(docs), tried, 20)[1].values()) < 50  # rows without ids are drawn one by one


def test_order_by_what_is_left():
    """A rule that rejects much, but only what a cheaper one has rejected already, comes last."""
    seconds, masks = {"cheap": 1.0, "same": 1.5, "rare": 4.0}, {0b000: 50, 0b011: 40, 0b100: 10}
    assert cascade.ordered(seconds, masks) == ["cheap", "rare", "same"]
    texts = {"a b " * 15: False, "word and more words that stand here in one line only once each so that nothing in it is ever said twice": True}
    for text, fine in texts.items():
        t, failed = cascade.measured(text)
        assert failed != fine and set(t.after_base().__dict__) == {"text", *cascade.BASE}


# Tokens


@pytest.fixture(scope="module")
def model():
    with open(queries.TOKENIZER, "rb") as f:
        return f.read()


def plain_best(codec, vocabulary, text):
    """The best score over text, by all pieces at all places."""
    own = {k + 1 for k, c in enumerate(text) if c == piece.MARK}
    s, longest = piece.MARK + text.replace(" ", piece.MARK), max(map(len, vocabulary))
    best = [0.0] + [-math.inf] * len(s)
    for e in range(1, len(s) + 1):
        for b in range(max(0, e - longest), e):
            if s[b:e] in vocabulary and not any(k in own for k in range(b, e)):
                best[e] = max(best[e], best[b] + vocabulary[s[b:e]])
        best[e] = max(best[e], best[e - 1] + codec.byte_score * len(s[e - 1].encode()))
    return best[-1]


def test_paths_are_best_and_decode(model):
    codec = piece.Codec(model)
    rows = piece.read_model(model)
    vocabulary = {p: s for p, s, k in rows if k in (1, 4)}
    texts = [t[:300] for t in pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()[:40]]
    texts += ["  a  b ", "▁x ▁", "\x00\n\t", " lead", "emoji 😀 中文", "a" * 300, "x  y", " ", "tail ", "😀"]
    for t in texts:
        ids = codec.encode(t)
        assert codec.decode(ids) == t
        assert sum(rows[i][1] if rows[i][2] in (1, 4) else codec.byte_score for i in ids) == pytest.approx(plain_best(codec, vocabulary, t), abs=1e-6)
    assert codec.encode("") == [] and codec.decode([]) == ""


def test_pieces_are_the_models(model):
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_proto=model)
    ours = piece.read_model(model)
    assert len(ours) == theirs.get_piece_size() and all(theirs.id_to_piece(i) == p for i, (p, _, _) in enumerate(ours))
    ids = piece.Codec(model).encode("A plain line of text, no more.")
    assert theirs.decode(ids) == "A plain line of text, no more."


def test_encode_and_decode_tables(spark, model):
    docs = with_clash(spark, [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "▁ é"), (4, "word " * 20_000)])
    rows = piece.encode(docs, model)
    got = rows.collect()
    assert len(got) == 6 and all(r.round_trip and r.n_tokens == len(r.ids) for r in got)
    back = Counter((r.doc_id, r.text) for r in piece.decode(rows, model).collect())
    assert back == Counter([(1, ""), (2, ""), (3, "a b"), (3, "a b"), (None, "▁ é"), (4, "word " * 20_000)])
    assert piece.encode(docs.limit(0), model).collect() == []


def a_model(pieces, normaliser=b""):
    """A unigram model's file: (piece, score, type) of each id."""
    import struct

    field = lambda n, data: bytes([n << 3 | 2, len(data)]) + data
    body = b"".join(field(1, field(1, p.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", s) + bytes([3 << 3, k])) for p, s, k in pieces)
    return body + field(2, bytes([3 << 3, 1])) + (field(3, normaliser) if normaliser else b"")


def test_user_defined_pieces_and_settings():
    pieces = [("<unk>", 0.0, 2), ("<sep>", 0.0, 4), ("<sep><sep>", 0.0, 4), ("▁", -2.0, 1), ("a", -1.0, 1), ("ab", -1.2, 1), ("<", -9.0, 1), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256))]
    codec = piece.Codec(a_model(pieces))
    assert [codec.pieces[i] for i in codec.encode("ab<sep><sep><sep>a")] == ["▁", "ab", "<sep><sep>", "<sep>", "a"]
    for t in ("<sep>", "a <sep> ab", "▁<sep>▁", "a<se", "é<sep>"):
        assert codec.decode(codec.encode(t)) == t
    bare = piece.Codec(a_model(pieces, bytes([3 << 3, 0])))
    assert [bare.pieces[i] for i in bare.encode("ab a")] == ["ab", "▁", "a"] and bare.decode(bare.encode(" ab")) == " ab"
    with pytest.raises(ValueError):
        piece.Codec(a_model(pieces, bytes([2 << 3 | 2, 1, 65])))


def test_a_very_long_word(model, monkeypatch):
    codec, text = piece.Codec(model), "漢字かな" * 5_000
    ids = codec.encode(text)
    assert codec.decode(ids) == text
    monkeypatch.setattr(piece, "LONG", 10**9)
    assert piece.Codec(model).encode(text) == ids


def test_cache_may_overflow(model, monkeypatch):
    monkeypatch.setattr(piece, "CACHE", 3)
    codec = piece.Codec(model)
    text = " ".join(f"word{i % 7}" for i in range(50))
    assert codec.decode(codec.encode(text)) == text and len(codec.known) <= 3
