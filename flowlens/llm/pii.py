"""PII surrogates: detected entities get keyed, type-consistent replacements.

Detection is a function of one text. A surrogate is a function of key, type, normalised value and attempt (HMAC), so every
mention of an entity in any document gets the same one without a lookup: gender and script of names, character classes,
separators and check digits stay as they were. What needs the whole corpus is distinctness: all distinct entities are
gathered once, and where two would share a surrogate, or one would equal a value that really occurs, all but the first move
to the next attempt until none is left. Only those moved entities have to be told to the replacing pass; they are sent
along while they are few (checked) and joined per document beyond that.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.common import Scratch, unused

DEFAULT_KEY = "replace-me"
#: Most moved entities that are sent along with the replacing function; beyond, they are joined.
MAX_SENT = 50_000

# Given names by gender and script, titles by gender, surname syllables by script.
GIVEN = {
    ("m", "latin"): ["James", "John", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Daniel", "Peter",
                     "Hans", "Klaus", "Stefan", "Jürgen", "Pierre", "Jean", "Michel", "Luc", "Carlos", "José", "Miguel",
                     "Pablo", "Andrew", "George"],
    ("f", "latin"): ["Mary", "Anna", "Linda", "Susan", "Karen", "Sarah", "Emily", "Laura", "Julia", "Sophie", "Claudia",
                     "Sabine", "Monika", "Ursula", "Marie", "Camille", "Isabelle", "Chloé", "Carmen", "Lucía", "Elena",
                     "Teresa", "Alice", "Emma"],
    ("m", "cyrillic"): ["Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Николай", "Михаил", "Андрей"],
    ("f", "cyrillic"): ["Анна", "Мария", "Елена", "Ольга", "Наталья", "Ирина", "Светлана", "Татьяна"],
}
TITLES = {"Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Mrs": "f", "Ms": "f",
          "Miss": "f", "Madam": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mademoiselle": "f", "Señora": "f",
          "Señorita": "f", "Dr": "", "Prof": "", "Professor": "", "Doktor": ""}
SYLLABLES = {
    "latin": (["Bar", "Bel", "Car", "Dal", "Fen", "Gar", "Hal", "Kel", "Lam", "Mar", "Nor", "Par", "Ros", "Sal", "Tor",
               "Wal"], ["a", "e", "i", "o", "an", "en", "in", "ar"],
              ["bert", "don", "field", "ford", "land", "ley", "man", "mont", "ner", "son", "ton", "well"]),
    "cyrillic": (["Бар", "Вол", "Гор", "Дан", "Зор", "Кар", "Лав", "Мор", "Ром", "Сав"], ["а", "е", "и", "о"],
                 ["ленко", "ник", "чук", "шин", "нов", "ров"]),
}
_GENDER = {name.casefold(): gender for (gender, _), names in GIVEN.items() for name in names}
_TITLE = {title.casefold(): gender for title, gender in TITLES.items()}
_KNOWN = {form for word in [*TITLES, *(name for names in GIVEN.values() for name in names)]
          for form in (word, word.upper())}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
# Each kind is looked for from characters it must have, so that ordinary prose is passed over quickly. Where matches
# overlap the leftmost counts, then the kind that comes first here.
KINDS = ["email", "secret", "key", "hex", "iban", "ip", "ssn", "card", "phone"]
_EMAIL = re.compile(r"(?<![\w.%+-])[\w.%+-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}")
_SECRET_NAMES = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "accesskey",
                 "access_key", "access-key")
_ASSIGNED = re.compile(r"[=:]")
_VALUE = re.compile(r"[ \t]*[\"']?([A-Za-z0-9_/+.\-]{6,})")
_KEY = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}\b")
_HEX = re.compile(r"[0-9a-fA-F]{32,}\b")
_IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")
_NUMBER_START = re.compile(r"[+(]|\d+")
_ADDRESS = rf"{_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d)"
_NUMBER = re.compile(
    rf"(?P<ip>(?<![\w.]){_ADDRESS})|(?P<ssn>\b\d{{3}}-\d{{2}}-\d{{4}}\b)"
    r"|(?P<card>(?<![\w+])(?:\d[ -]?){12,18}\d(?!\w))"
    r"|(?P<phone>(?<![\w.])(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\w)|\+\d{8,15}|(?:\+\d{1,3}[ .-]?)?\(\d{1,5}\)[ .-]?\d{2,5}(?:[ .-]?\d{2,5}){1,3}"
    r"|\+\d{1,3}(?:[ .-]\d{2,5}){2,5}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\w))")

# What a card or phone must not take in as further digit groups of its own.
_NEXT = re.compile(rf"(?P<own>{_ADDRESS}|\d{{3}}-\d{{2}}-\d{{4}}\b)|(?P<phone>\d{{3}}[ .-]\d{{3}}[ .-]\d{{4}}(?!\w))"
                   r"|\d{4}([ -])(?:\d{4}\3\d{4}\3\d{4}|\d{6}\3\d{4,5})(?!\w)")
_GAP = re.compile(r"[ .-]+")
_DECIMAL = re.compile(r"\.\d")


def _word_before(text: str, at: int) -> bool:
    return at > 0 and (text[at - 1].isalnum() or text[at - 1] == "_")


def _secrets(text: str) -> Iterator[tuple[int, int]]:
    """Values assigned to a name that ends like a credential's."""
    for sign in _ASSIGNED.finditer(text):
        end = sign.start()
        while end and text[end - 1] in " \t":
            end -= 1
        if text[max(0, end - 12) : end].lower().endswith(_SECRET_NAMES) and (value := _VALUE.match(text, sign.end())):
            yield value.span(1)


def _cut(text: str, match: re.Match) -> tuple[int, str | None]:
    """(end, kind) of a number without the entity that follows it after a separator; kind None if nothing is left.

    A phone's own groups may look like an address ('+45 12.34.56.78'): what follows is cut off only if the rest is whole,
    or if the match ends inside of it.
    """
    start, end, kind = match.start(), match.end(), match.lastgroup
    if kind not in ("card", "phone"):
        return end, kind
    gaps = list(_GAP.finditer(text, start, end))
    for gap in gaps:
        if follows := _NEXT.match(text, gap.end()):
            front = _NUMBER.fullmatch(text, start, gap.start())
            if front and (follows["own"] or sum(map(str.isdigit, front[0])) >= 10):
                return front.end(), front.lastgroup
            if follows.end() > end and follows.lastgroup:
                return gap.end(), None
    if gaps and _DECIMAL.match(text, end):
        if front := _NUMBER.fullmatch(text, start, gaps[-1].start()):
            return front.end(), front.lastgroup
    if kind == "card" and _luhn(_normal(kind, match[0])):
        for gap in gaps:
            front = _NUMBER.fullmatch(text, start, gap.start())
            if front and front.lastgroup == "card" and not _luhn(_normal(kind, front[0])):
                return front.end(), kind
    return end, kind


def _numbers(text: str) -> Iterator[tuple[int, int, str]]:
    """Addresses, cards, phones; none begins inside a run of digits or takes in the one after it."""
    at = 0
    while start := _NUMBER_START.search(text, at):
        match = _NUMBER.match(text, start.start())
        at, kind = _cut(text, match) if match else (start.end(), None)
        if kind:
            yield start.start(), at, kind


def _ibans(text: str) -> Iterator[tuple[int, int, str]]:
    """Account numbers; one that fails its check digits ends before the first group without which it passes them."""
    at = 0
    while match := _IBAN.search(text, at):
        at = match.end()
        if not _iban_holds(match[0]):
            for gap in _GAP.finditer(text, match.start(), at):
                if _IBAN.fullmatch(text, match.start(), gap.start()) and _iban_holds(text[match.start() : gap.start()]):
                    at = gap.start()
                    break
        yield match.start(), at, "iban"


def _iban_holds(mention: str) -> bool:
    value = mention.replace(" ", "")
    return int("".join(str(int(ch, 36)) for ch in value[4:] + value[:4])) % 97 == 1


def _formats(text: str) -> Iterator[tuple[int, int, str]]:
    if "@" in text:
        yield from ((*m.span(), "email") for m in _EMAIL.finditer(text))
    yield from ((a, b, "secret") for a, b in _secrets(text))
    for kind, pattern in (("key", _KEY), ("hex", _HEX)):
        yield from ((*m.span(), kind) for m in pattern.finditer(text) if not _word_before(text, m.start()))
    yield from (found for found in _ibans(text) if not _word_before(text, found[0]))
    yield from _numbers(text)


_CAPITAL = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][\w’'-]*"
_NAMES = re.compile(rf"\b{_CAPITAL}(?:\.? {_CAPITAL})+")
_TOKEN = re.compile(_CAPITAL)


def _normal(kind: str, mention: str) -> str:
    if kind in ("phone", "card", "ssn"):
        return ("+" if mention[0] == "+" else "") + re.sub(r"\D", "", mention)
    if kind == "iban":
        return mention.replace(" ", "")
    return mention if kind in ("secret", "key", "hex") else mention.lower()


def _names(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Given names followed by a surname, and surnames after a title; other capitalised words are left alone."""
    if _KNOWN.isdisjoint(_TOKEN.findall(text)):
        return
    surnames = set()
    for run in _NAMES.finditer(text):
        tokens = list(_TOKEN.finditer(text, run.start(), run.end()))
        i = 0
        while i + 1 < len(tokens):
            word = tokens[i][0]
            title, gender = _TITLE.get(word.casefold()), _GENDER.get(word.casefold())
            if title is None and (gender is None or word.isupper()):
                i += 1
                continue
            i += title is not None
            gender = _GENDER.get(tokens[i][0].casefold())
            if gender is not None and i + 1 < len(tokens):
                yield tokens[i].start(), tokens[i].end(), f"given-{gender}", tokens[i][0].casefold()
                i += 1
            yield tokens[i].start(), tokens[i].end(), "surname", tokens[i][0].casefold()
            surnames.add(tokens[i][0])
            i += 1
    for word in _TOKEN.finditer(text) if surnames else ():  # the same person by surname alone
        if word[0] in surnames:
            yield word.start(), word.end(), "surname", word[0].casefold()


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """``(start, end, kind, normalised value)`` of the entities of a text, in order and without overlap."""
    rank = {kind: i for i, kind in enumerate(KINDS)}
    found = [(a, rank[kind], b, kind, _normal(kind, text[a:b])) for a, b, kind in _formats(text)]
    found += [(a, len(KINDS), b, kind, value) for a, b, kind, value in set(_names(text))]
    kept, end = [], 0
    for a, _, b, kind, value in sorted(found):
        if a >= end:
            kept.append((a, b, kind, value))
            end = b
    return kept


def _script(value: str) -> str:
    return "cyrillic" if any("Ѐ" <= ch <= "ӿ" for ch in value) else "latin"


def _stream(key: str, *parts: str) -> Iterator[int]:
    n, seed = 0, "\0".join(parts).encode()
    while True:
        yield from hmac.new(key.encode(), seed + n.to_bytes(4, "big"), hashlib.sha256).digest()
        n += 1


def _like(ch: str, draw: Iterator[int]) -> str:
    """A character of the same class, case and script."""
    if ch.isdecimal():
        return str(next(draw) % 10)
    if not ch.isalpha():
        return ch
    name = unicodedata.name(ch, "")
    first, size = ("а", 32) if name.startswith("CYRILLIC") else ("α", 17) if name.startswith("GREEK") else ("a", 26)
    made = chr(ord(first) + (next(draw) * 256 + next(draw)) % size)
    return made.upper() if ch.isupper() else made


def _luhn(digits: str) -> int:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10


def _mod97(text: str) -> int:
    """The remainder that account numbers are checked by; letters count from 10."""
    return int("".join(str(int(ch, 36)) for ch in text)) % 97


# Country calling codes of one and two digits; all others have three.
_SHORT_CODES = {"1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48",
                "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82",
                "84", "86", "90", "91", "92", "93", "94", "95", "98"}


def _country(digits: str) -> int:
    """Digits of the country code at the start of an international number."""
    return next((n for n in (1, 2) if digits[:n] in _SHORT_CODES), min(3, len(digits) - 1))


def surrogate(kind: str, value: str, key: str, attempt: int) -> str:
    """The replacement of a normalised value; the same length and character classes, never the value itself."""
    for retry in range(64):
        draw = _stream(key, kind, value, str(attempt), str(retry))
        if kind.startswith("given"):
            names = GIVEN[kind[-1], _script(value)]
            made = "-".join(names[next(draw) % len(names)].lower() for _ in range(1 + attempt))
        elif kind == "surname":
            parts = SYLLABLES[_script(value)]
            made = parts[0][next(draw) % len(parts[0])].lower() + "".join(
                parts[1][next(draw) % len(parts[1])] for _ in range(1 + attempt)) + parts[2][next(draw) % len(parts[2])]
        elif kind == "ip":
            made = ".".join(str(1 + next(draw) % 254) for _ in range(4))
        elif kind == "email":
            head, _, top = value.rpartition(".")
            made = "".join(_like(ch, draw) for ch in head) + "." + top
        elif kind == "key":
            made = value[:4] + "".join(_like(ch, draw) for ch in value[4:])
        elif kind == "hex":
            made = "".join("0123456789abcdef"[next(draw) % 16] for _ in value)
            made = made.upper() if value.upper() == value else made
        elif kind == "iban":
            body = "".join(_like(ch, draw) for ch in value[4:])
            check = f"{98 - _mod97(body + value[:2] + '00'):02d}" if _mod97(value[4:] + value[:4]) == 1 else "".join(
                _like(ch, draw) for ch in value[2:4])
            made = value[:2] + check + body
        elif kind == "phone" and value[0] == "+":
            code = 1 + _country(value[1:])
            made = value[:code] + str(1 + next(draw) % 9) + "".join(str(next(draw) % 10) for _ in value[code + 1 :])
        elif kind in ("phone", "card", "ssn"):
            keep = kind == "card" or kind == "phone" and len(value) > 10
            made = (value[0] if keep else str(1 + next(draw) % 9)) + "".join(str(next(draw) % 10) for _ in value[1:])
            if kind == "card":
                right = [d for d in "0123456789" if (_luhn(made[:-1] + d) == 0) == (_luhn(value) == 0)]
                made = made[:-1] + right[next(draw) % len(right)]
        else:
            made = "".join(_like(ch, draw) for ch in value)
        if made != value:
            return made
    return made


def render(kind: str, mention: str, made: str) -> str:
    """A surrogate in the form of one mention: its separators and its case."""
    if kind in ("phone", "card", "ssn", "iban"):
        rest = iter(ch for ch in made if ch.isalnum())
        return "".join(next(rest) if ch.isalnum() else ch for ch in mention)
    if kind.startswith("given") or kind == "surname":
        return made.upper() if mention.isupper() and len(mention) > 1 else made.title()
    if kind == "email":
        return made.upper() if mention.isupper() else "".join(
            new.upper() if old.isupper() else new for old, new in zip(mention, made))
    return made


def replace(text: str, key: str, moved: dict[tuple[str, str], int] | None = None) -> tuple[str, list]:
    """(text with surrogates, ``(start, end, kind, surrogate)`` of each in the new text)."""
    parts, spans, at, size = [], [], 0, 0
    for start, end, kind, value in detect(text):
        made = render(kind, text[start:end], surrogate(kind, value, key, (moved or {}).get((kind, value), 0)))
        parts += [text[at:start], made]
        size += start - at
        spans.append((size, size + len(made), kind, made))
        size += len(made)
        at = end
    return "".join(parts) + text[at:], spans


_ENTITY = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())]))


@F.pandas_udf(_ENTITY)
def _entities(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.fillna("").map(lambda text: sorted({(kind, value) for _, _, kind, value in detect(text)})).map(
            lambda found: [{"kind": kind, "value": value} for kind, value in found])


def moved_entities(entities: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """``kind, value, attempt`` of those of the distinct ``entities(kind, value)`` whose first surrogate is taken."""
    @F.pandas_udf(T.StringType())
    def make(kind: pd.Series, value: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(k, v, key, a) for k, v, a in zip(kind, value, attempt)])

    def with_surrogate(df):
        return df.withColumn("made", make("kind", "value", "attempt"))

    real = entities.select("kind", F.col("value").alias("made"))
    given = scratch.keep(with_surrogate(entities.withColumn("attempt", F.lit(0))), "surrogates")
    while True:
        first = given.groupBy("kind", "made").agg(F.min(F.struct("attempt", "value")).alias("first"))
        # names are shared by many people anyway: a made name may be one that occurs
        occurs = real.where(~F.col("kind").startswith("given")).withColumn("occurs", F.lit(True))
        judged = (given.join(first, ["kind", "made"]).join(occurs, ["kind", "made"], "left")
                  .withColumn("lost", (F.col("first") != F.struct("attempt", "value")) | F.coalesce("occurs", F.lit(False))))
        judged = scratch.keep(judged.select("kind", "value", "attempt", "made", "lost"), "surrogates")
        if judged.where("lost").isEmpty():
            return judged.where("attempt > 0").select("kind", "value", "attempt")
        again = with_surrogate(judged.where("lost").select("kind", "value", (F.col("attempt") + 1).alias("attempt")))
        given = judged.where("not lost").select("kind", "value", "attempt", "made").unionByName(again)


def protect(docs: DataFrame, key: str = DEFAULT_KEY, column: str = "text", spans: str | None = None,
            scratch: Scratch | None = None, max_sent: int = MAX_SENT) -> DataFrame:
    """``docs`` with surrogates in ``column``; ``spans`` names one more column for what was replaced and where.

    Null texts stay null and empty ones empty; documents without entities are unchanged; repeated rows get equal texts;
    an empty table stays empty. Very long texts are read whole. Other columns pass as they are, whatever their names; a column
    named like ``spans`` is replaced.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    text, own_made = F.col(column), unused(docs, "__made")
    found = docs.select(F.explode(_entities(text)).alias("e")).select("e.kind", "e.value").distinct()
    entities = scratch.keep(found, "entities")
    moved = moved_entities(entities, key, scratch)
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                         T.StructField("kind", T.StringType()), T.StructField("surrogate", T.StringType())])
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("spans", T.ArrayType(span))])

    def rows(texts, told):
        out = []
        for value, own in zip(texts, told):
            made, where = (None, []) if value is None else replace(value, key, own)
            out.append((made, [dict(zip(("start", "end", "kind", "surrogate"), x)) for x in where]))
        return pd.DataFrame(out, columns=["text", "spans"])

    if moved.limit(max_sent + 1).count() <= max_sent:
        sent = {(row.kind, row.value): row.attempt for row in moved.collect()}

        @F.pandas_udf(schema)
        def put(texts: pd.Series) -> pd.DataFrame:
            return rows(texts, [sent] * len(texts))

        made = docs.withColumn(own_made, put(text))
    else:
        @F.pandas_udf(schema)
        def put_own(texts: pd.Series, told: pd.Series) -> pd.DataFrame:
            return rows(texts, [{(x["kind"], x["value"]): x["attempt"] for x in own} if own is not None else {}
                                for own in told])

        place = F.struct(F.xxhash64(text), F.length(text), F.sha2(text, 256))
        at, told = unused(docs, "__place"), unused(docs, "__moved")
        own = (docs.select(place.alias(at), F.explode(_entities(text)).alias("e"))
               .select(at, "e.kind", "e.value").distinct().join(moved, ["kind", "value"])
               .groupBy(at).agg(F.collect_set(F.struct("kind", "value", "attempt")).alias(told)))
        made = (docs.withColumn(at, place).join(own, at, "left")
                .withColumn(own_made, put_own(text, F.col(told))))
    new = [F.col(f"{own_made}.text").alias(name) if name == column else F.col(f"`{name}`")
           for name in docs.columns if name != spans]
    return made.select(*new, *([F.col(f"{own_made}.spans").alias(spans)] if spans else []))


def report(docs: DataFrame) -> DataFrame:
    """The query: every document with surrogates, and how many mentions were replaced."""
    made = protect(docs.select("doc_id", "text"), spans="__spans")
    return made.select("doc_id", "text", F.size("__spans").cast("long").alias("n_entities"))
