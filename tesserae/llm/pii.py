"""Personal data: surrogates by a key, consistent in type, gender, script and format.

Every entity has a canonical form (a phone number's digits, a lower-cased address, each part of a name by itself), so all
mentions of it get one surrogate. Names are found by titles, given names, words that introduce a person and, in Chinese,
family names with a form of address; once found, their parts are found again wherever the text has them, alone or not.
A given name's gender is its own, not its title's, so that a person has one surrogate under any title. A surrogate is drawn from an HMAC of kind, canonical form and attempt, and laid into the
format of each mention. The entities of the whole corpus are checked for collisions: of those that draw one surrogate, or
a surrogate that is itself someone's, all but the least draw again, until none are left. Only entities that drew again
need a table; they are few, and are joined where they are not.
"""

from __future__ import annotations

import hashlib
import hmac
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound_batches

#: Entities that drew again go to the workers as a table up to so many, and by a join beyond it.
MOST_SENT = 100_000
# Honorifics by gender, and given names that tell an untitled person's name.
MALE = "Mr Herr Herrn Monsieur Señor Sr Signor Don Г-н Господин Κύριος Κος".split()
FEMALE = "Mrs Ms Miss Frau Madame Mme Mlle Señora Sra Srta Signora Г-жа Госпожа Κυρία Κα".split()
NEUTRAL = "Dr Prof".split()
DOTTED = "Mr Mrs Ms Sr Sra Srta Mme Mlle Dr Prof Κος Κα".split()  # abbreviations; after the others a full stop ends a sentence
MALE_NAMES = "James John Robert Michael William David Thomas Hans Peter Klaus Stefan Pierre Jean Louis Carlos José Juan Miguel Иван Сергей Дмитрий".split()
FEMALE_NAMES = "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Anna Petra Sabine Ursula Marie Sophie Claire María Carmen Lucía Ольга Анна Елена".split()

# Words that introduce a person's full name, and Chinese family names and forms of address.
CUES = "Contact Kontakt Contacto Ansprechpartner Ansprechpartnerin Attn Dear Liebe Lieber Cher Chère Estimado Estimada Sincerely Regards Signed Author Autor Autorin Auteur Name Nombre Nom".split()
FAMILY_HAN = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文"
ADDRESS_HAN = "先生 女士 小姐 博士 教授 同志 老师".split()

_PART = r"[^\W\d_a-zà-ÿа-яα-ωά-ώ][^\W\d_A-ZÀ-ÞА-ЯΑ-Ω]+(?:[-'’][^\W\d_]+)?"
_TITLES = "|".join(map(re.escape, sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True)))
_GIVEN = "|".join(MALE_NAMES + FEMALE_NAMES)
PATTERNS: list[tuple[str, re.Pattern]] = [
    ("SECRET", re.compile(r"(?i:\b(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth[_-]?token|private[_-]?key)\b[\"']?\s*[:=]\s*)[\"']?([A-Za-z0-9+/_.~=-]{8,})|\b(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{32,})\b")),
    ("EMAIL", re.compile(r"((?<![\w.+%-])[\w+%-]+(?:\.[\w+%-]+)*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,})")),
    ("IBAN", re.compile(r"\b([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?)\b")),
    ("CARD", re.compile(r"(?<![\d.])(\d{13,19}|\d{4}([ -])\d{4}\2\d{4}\2\d{1,7}|3\d{3}[ -]\d{6}[ -]\d{5})(?!\d)")),
    ("IP", re.compile(r"(?<![\d.])((?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?![\d]|\.\d)")),
    ("SSN", re.compile(r"(?<![\d-])(\d{3}-\d{2}-\d{4})(?![\d-])")),
    ("PHONE", re.compile(r"(?<![\w.+])(\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)")),
]
NAMES = re.compile(rf"\b(?:(?P<title>{_TITLES})\b(?P<stop>\.?)(?: +(?:Dr|Prof)\b\.?)* +(?P<titled>{_PART}(?: {_PART}){{0,2}})|(?P<given>{_GIVEN}) (?P<family>{_PART}))")
INTRODUCED = re.compile(rf"\b(?:{'|'.join(CUES)})\b[.,:]? +(?P<first>{_PART} {_PART}(?: {_PART})?)(?P<more>(?:(?:,| or| and| und| oder| y| o| et| ou) {_PART} {_PART})*)")
HAN = re.compile(rf"(?P<family>[{FAMILY_HAN}])(?P<given>[\u4e00-\u9fff]{{1,2}}?)(?:{'|'.join(ADDRESS_HAN)})|(?:姓名|联系人|作者)[:：] ?(?P<family2>[{FAMILY_HAN}])(?P<given2>[\u4e00-\u9fff]{{1,2}})(?![\u4e00-\u9fff])")
_JOINED = re.compile(r"(?:,| or| and| und| oder| y| o| et| ou) ")
_HINT = re.compile(r"[0-9@]|(?i:passw|pwd|secret|token|key)")
_WORDS = re.compile(r"[^ ]+")
_CUE, _HAN = re.compile("|".join(CUES)), re.compile("[\u4e00-\u9fff]")
_CAPITAL = re.compile(rf"\b{_PART}\b")
_MALE_LOW, _FEMALE_LOW = {n.lower() for n in MALE_NAMES}, {n.lower() for n in FEMALE_NAMES}
# Names that are words too; they are found again only where they were found first.
_COMMON = frozenset("may will mark rose grace hope bill rich young long best wolf klein groß lang kurz blanc petit grand".split())

_VOWELS = "aeiou"
_CONSONANTS = "bcdfghjklmnpqrstvwxyz"
#: Letters of a script that stand for each other, lower case.
POOLS = ["àáâäèéêëìíîïòóôöùúûüæœ", "çñßšž", "абвгдежзиклмнопрстуфхцчшщэюя", "αβγδεζηθικλμνξοπρστυφχψω"]
#: Characters of drawn Chinese given names.
GIVEN_HAN = "安博晨达恩凡光浩佳凯兰朗立明宁平琪然瑞思涛婷维文晓欣雅颖宇泽哲子"
#: Syllables of drawn names by script: starts, middles, and the ends of a woman's, a man's and a family name.
SYLLABLES = {
    "latin": ("Al Be Ca Da El Fa Ga He Is Jo Ka Le Ma Ne Or Pa Ro Sa Te Ve".split(), "ba bri co da do fe go la li lo ma mi na no ra ri ro sa ti vo".split(), {"f": "lia nia ra sa tta".split(), "m": "bert dor lan mir ton".split(), "n": "len ris rin vel yn".split(), "s": "berg dorf field mann nova sen ski ton vale wick".split()}),
    "greek": ("Αλ Βα Γε Δη Ελ Θε Κα Λε Μα Νι Πε Σα Τα".split(), "βα δι κα λι μα νι ρο τα".split(), {"f": "λια να ρα σα".split(), "m": "νος ρος της λας".split(), "n": "λι ρι νο".split(), "s": "κης πουλος ιδης ακος".split()}),
    "cyrillic": ("Ал Бо Ва Га Да Зо Ки Ла Ма Ни Ра Са Та".split(), "ва ди ка ла ли ми на ри ро та".split(), {"f": "лия на ра са".split(), "m": "дор мир слав тон".split(), "n": "лен рин".split(), "s": "ев ин ов ский".split()}),
}


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def _iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of the entities of a text, in order, apart from each other."""
    found: list[tuple[int, int, str, str]] = []
    taken = bytearray(len(text))
    if _HINT.search(text):
        for kind, pattern in PATTERNS:
            if kind == "EMAIL" and "@" not in text:
                continue
            for m in pattern.finditer(text):
                group = 1 if m[1] is not None else 2
                mention = m[group]
                digits = re.sub(r"\D", "", mention)
                if kind == "SECRET" and not any(map(str.isalnum, mention)):
                    continue  # a line to fill in, or a ruler
                if kind == "CARD" and len(digits) != 16 and not luhn(digits):
                    continue
                if kind == "PHONE" and not 7 <= len(digits) <= 15:
                    continue
                if kind == "IBAN":
                    plain = mention.replace(" ", "")
                    if _iban_check(plain[:2], plain[4:]) != plain[2:4]:
                        continue
                    canon = plain
                else:
                    canon = digits if kind in ("CARD", "PHONE", "SSN") else mention.lower() if kind == "EMAIL" else mention
                a, b = m.span(group)
                if 1 not in taken[a:b]:
                    found.append((a, b, kind, canon))
                    taken[a:b] = b"\1" * (b - a)
    names: dict[str, str] = {}  # a part's kind

    def named(spans: list[tuple[int, int]], gender: str) -> None:
        if not spans or any(1 in taken[a:b] for a, b in spans):
            return
        for k, (a, b) in enumerate(spans):
            part = text[a:b].lower()
            kind = _kind(part, k < len(spans) - 1, gender)
            found.append((a, b, kind, part))
            taken[a:b] = b"\1" * (b - a)
            names.setdefault(text[a:b], kind)

    def words(at: int, shown: str) -> list[tuple[int, int]]:
        return [(at + w.start(), at + w.end()) for w in _WORDS.finditer(shown)]

    for m in NAMES.finditer(text):
        if m["titled"]:
            if not m["stop"] or m["title"] in DOTTED:
                named(words(m.start("titled"), m["titled"]), "n")
        else:
            named([m.span("given"), m.span("family")], "n")
    if _CUE.search(text):
        for m in INTRODUCED.finditer(text):
            named(words(m.start("first"), m["first"]), "n")
            at = m.start("more")
            for shown in _JOINED.split(m["more"])[1:]:
                at = text.index(shown, at)
                named(words(at, shown), "n")
                at += len(shown)
    if _HAN.search(text):
        for m in HAN.finditer(text):
            given, family = ("given", "family") if m["family"] else ("given2", "family2")
            if 1 not in taken[m.start(family) : m.end(given)]:
                found.append((*m.span(family), "NAME_S", m[family]))
                found.append((*m.span(given), "NAME_N", m[given]))
                taken[m.start(family) : m.end(given)] = b"\1" * (m.end(given) - m.start(family))
                names.setdefault(m[family] + m[given], "")
    if names:  # later mentions, and those before: the parts wherever they stand as words
        han = [n for n, kind in names.items() if not kind]
        again = [n for n, kind in names.items() if kind and n.lower() not in _COMMON]
        if han:
            for m in re.finditer("|".join(map(re.escape, sorted(han, key=len, reverse=True))), text):
                if 1 not in taken[m.start() : m.end()]:
                    found += [(m.start(), m.start() + 1, "NAME_S", m[0][0]), (m.start() + 1, m.end(), "NAME_N", m[0][1:])]
                    taken[m.start() : m.end()] = b"\1" * (m.end() - m.start())
        known = set(again)
        if known:
            for m in _CAPITAL.finditer(text):
                if m[0] in known and 1 not in taken[m.start() : m.end()]:
                    found.append((m.start(), m.end(), names[m[0]], m[0].lower()))
                    taken[m.start() : m.end()] = b"\1" * (m.end() - m.start())
    return sorted(found)


def _kind(part: str, given: bool, gender: str) -> str:
    if not given:
        return "NAME_S"
    return "NAME_M" if part in _MALE_LOW else "NAME_F" if part in _FEMALE_LOW else f"NAME_{gender.upper()}"


class _Draws:
    """Numbers from an HMAC, as many as are asked for."""

    def __init__(self, key: bytes, *parts):
        self.key, self.text, self.block, self.pool = key, "\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.new(self.key, self.text + self.block.to_bytes(4, "big"), hashlib.sha256).digest()
            self.block += 1
        value, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return value % n

    def pick(self, choices):
        return choices[self.below(len(choices))]


def _letter(c: str, draws: _Draws) -> str:
    low = c.lower()
    pool = _VOWELS if low in _VOWELS else _CONSONANTS if low in _CONSONANTS else next((p for p in POOLS if low in p), None)
    if pool is None:
        return c if not c.isalpha() else draws.pick(_CONSONANTS)
    drawn = draws.pick(pool)
    return drawn.upper() if c.isupper() and len(drawn.upper()) == 1 else drawn


def _same_classes(text: str, draws: _Draws) -> str:
    return "".join(draws.pick("0123456789") if c in "0123456789" else _letter(c, draws) if c.isalpha() else c for c in text)


def _more(n: int, draws: _Draws) -> str:
    return "".join(draws.pick(_CONSONANTS + "0123456789") for _ in range(n))


def draw(kind: str, canon: str, attempt: int, key: bytes) -> str:
    """The canonical form of an entity's surrogate. From the fourth attempt on it leaves a format that may be full."""
    d = _Draws(key, kind, canon, attempt)
    wider = attempt // 4
    if kind == "EMAIL":
        local, _, domain = canon.rpartition("@")
        name, _, top = domain.rpartition(".")
        return f"{_same_classes(local, d)}{_more(wider, d)}@{_same_classes(name, d)}.{top}"
    if kind == "IP":
        octets = canon.split(".")
        if wider > 8:  # the corpus has most of all addresses: one of the longer kind
            return ":".join(["2001", "db8", *(f"{d.below(65536):x}" for _ in range(6))])
        keep = 2 if octets[:2] == ["192", "168"] else 1 if octets[0] in ("10", "127") else 0
        if wider:  # any width; then any private address, and at last any
            given = octets[:keep] if wider == 1 or not keep else ["10"] if wider < 4 else []
            return ".".join([*given, *(str(1 + d.below(254)) for _ in octets[len(given) :])])
        low = {1: (1, 9), 2: (10, 99), 3: (100, 254)}
        return ".".join(o if k < keep else str(low[len(o)][0] + d.below(low[len(o)][1] - low[len(o)][0] + 1)) for k, o in enumerate(octets))
    if kind == "CARD":
        body = canon[0] + "".join(d.pick("0123456789") for _ in canon[1:-1]) + "".join(d.pick("0123456789") for _ in range(max(0, wider - 8)))
        right = next(c for c in "0123456789" if luhn(body + c))
        return body + (right if luhn(canon) else str((int(right) + 1 + d.below(9)) % 10))
    if kind in ("PHONE", "SSN"):
        keep = max(0, len(canon) - 10) if kind == "PHONE" else 0  # the country's digits
        drawn = "".join(d.pick("0123456789") for _ in canon[keep:])
        if wider:  # any first digit, and then longer numbers
            return canon[:keep] + drawn + "".join(d.pick("0123456789") for _ in range(max(0, wider - 1 if kind == "PHONE" else wider - 8)))
        return canon[:keep] + (str(2 + d.below(8)) + drawn[1:] if canon[keep : keep + 1] not in ("", "0") else "0" + drawn[1:])
    if kind == "IBAN":
        rest = "".join(d.pick("0123456789") if c.isdigit() and not wider else d.pick("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ") if wider else d.pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for c in canon[4:])
        return canon[:2] + _iban_check(canon[:2], rest) + rest
    if kind == "SECRET":
        if re.fullmatch(r"[0-9a-f]+", canon):
            return "".join(d.pick("0123456789abcdef") for _ in range(len(canon) + wider))
        head = re.match(r"AKIA|gh[pousr]_|sk-|xox[abprs]-", canon)
        k = head.end() if head else 0
        return canon[:k] + _same_classes(canon[k:], d) + _more(wider, d)
    if _HAN.search(canon):
        return d.pick(FAMILY_HAN) + (d.pick(GIVEN_HAN) * bool(wider)) if kind == "NAME_S" else "".join(d.pick(GIVEN_HAN) for _ in range(len(canon) + wider))
    starts, middles, ends = SYLLABLES["cyrillic" if re.search("[а-яё]", canon) else "greek" if re.search("[α-ωά-ώ]", canon) else "latin"]
    middle = "".join(d.pick(middles) for _ in range(1 + d.below(2) + wider))
    return (d.pick(starts) + middle + d.pick(ends[kind[-1].lower()])).lower()


def render(mention: str, kind: str, surrogate: str) -> str:
    """A surrogate in the format of a mention."""
    if kind in ("CARD", "PHONE", "SSN", "IBAN"):
        rest = iter(surrogate)
        return "".join(next(rest) if c.isalnum() else c for c in mention) + "".join(rest)
    if kind == "EMAIL":
        return "".join(s.upper() if len(mention) == len(surrogate) and mention[k].isupper() and len(s.upper()) == 1 else s for k, s in enumerate(surrogate))
    if kind.startswith("NAME"):
        return surrogate.upper() if len(mention) > 1 and mention.isupper() else surrogate[:1].upper() + surrogate[1:]
    return surrogate


def entities(docs: DataFrame) -> DataFrame:
    """The distinct (kind, canon) of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sorted({(k, c) for text in batch.column(0).to_pylist() for _, _, k, c in detect(text or "")})
            yield pa.record_batch([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], ["kind", "canon"])

    bound_batches(docs.sparkSession)
    return docs.select(F.col("text").cast("string")).mapInArrow(run, "kind string, canon string").distinct()


def redrawn(found: DataFrame, key: bytes, scratch: Scratch) -> DataFrame:
    """(kind, canon, attempt) of the entities that had to draw again, each with its last attempt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([draw(k, c, a, key) for k, c, a in rows], pa.string())], ["kind", "canon", "attempt", "surrogate"])

    drawn = lambda df: df.select("kind", "canon", "attempt").mapInArrow(run, "kind string, canon string, attempt int, surrogate string")
    now = scratch.save(drawn(found.withColumn("attempt", F.lit(0))), "draws0")
    for k in itertools.count(1):  # each draw has more values than those before it
        classed = now.withColumn("class", F.when(F.startswith("kind", F.lit("NAME")), "NAME").otherwise(F.col("kind")))
        held = classed.groupBy("class", "surrogate").agg(F.count("*").alias("n"), F.min(F.struct("kind", "canon")).alias("keeper")).filter("n > 1")
        twice = classed.join(held, ["class", "surrogate"]).filter(F.struct("kind", "canon") != F.col("keeper")).select("kind", "canon")
        someones = classed.join(classed.select("class", F.col("canon").alias("surrogate")).distinct(), ["class", "surrogate"]).select("kind", "canon")
        again = scratch.save(twice.unionByName(someones).distinct(), f"again{k}")
        if again.isEmpty():
            return now.filter("attempt > 0").select("kind", "canon", "attempt")
        marked = now.join(again.withColumn("hit", F.lit(1)), ["kind", "canon"], "left")
        kept = marked.filter("hit is null").select("kind", "canon", "attempt", "surrogate")
        now = scratch.save(kept.unionByName(drawn(marked.filter("hit = 1").withColumn("attempt", F.col("attempt") + 1))), f"draws{k}")
        scratch.drop(f"draws{k - 1}")


def replace(text: str, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str, int]:
    """The text with surrogates, and how many mentions were replaced."""
    out, at, n = [], 0, 0
    for start, end, kind, canon in detect(text):
        out += [text[at:start], render(text[start:end], kind, draw(kind, canon, attempts.get((kind, canon), 0), key))]
        at, n = end, n + 1
    return "".join([*out, text[at:]]), n


def pseudonymise(docs: DataFrame, key: bytes, most_sent: int = MOST_SENT) -> DataFrame:
    """docs with surrogates in text, n_entities (mentions replaced) behind the other columns.

    Equal entities get equal surrogates across all rows, different ones of a kind different ones, none of them a value
    that the corpus has of that kind; names also differ across their kinds. A text of any length is read whole. Texts
    without entities are unchanged; a null text stays null; repeated rows stay
    alike; an empty table gives an empty result. Columns called n_entities are replaced, others are kept; names that
    begin with __tess are the operator's own.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pii")
    docs = docs.drop("n_entities")
    again = scratch.save(redrawn(entities(docs), key, scratch), "redrawn")
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", n_entities bigint"
    at = names.index("text")

    def out(batch, rows):
        texts, n = zip(*rows, strict=True) if rows else ((), ())
        cols = [batch.column(k) if k != at else pa.array(texts, pa.string()) for k in range(len(names))]
        return pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64())], [*names, "n_entities"])

    if again.count() <= most_sent:
        sent = spark.sparkContext.broadcast({(r["kind"], r["canon"]): r["attempt"] for r in again.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield out(batch, [(None, 0) if t is None else replace(t, key, sent.value) for t in batch.column(at).to_pylist()])

        return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, schema)

    def mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h, k, c) for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, c in {(k, c) for _, _, k, c in detect(text or "")}]
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))], ["h", "kind", "canon"])

    keyed = docs.withColumn("__tess_h", F.xxhash64("text"))
    own = keyed.select("__tess_h", F.col("text").cast("string")).mapInArrow(mentions, "h bigint, kind string, canon string").distinct()
    own = own.join(again, ["kind", "canon"]).groupBy(F.col("h").alias("__tess_own_h")).agg(F.collect_list(F.struct("kind", "canon", "attempt")).alias("__tess_own"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables = [{(x["kind"], x["canon"]): x["attempt"] for x in own or ()} for own in batch.column(len(names)).to_pylist()]
            yield out(batch, [(None, 0) if t is None else replace(t, key, a) for t, a in zip(batch.column(at).to_pylist(), tables, strict=True)])

    return keyed.join(own, F.col("__tess_h") == F.col("__tess_own_h"), "left").select(*names, "__tess_own").mapInArrow(each, schema)
