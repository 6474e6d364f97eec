"""Personal data replaced by keyed surrogates of the same kind and form.

Every replacement is a permutation within the entity's form: a Feistel network over the mixed radix of
its characters, keyed by type and form and walked on where it would leave the form's own domain. The
domains of a type are disjoint and each is mapped onto itself, so different entities keep different
surrogates and the same entity has the same one in every document, without any state shared between
documents. Person names, found by titles, given names and what stands around them, change vowels for
vowels and consonants for consonants of their script and keep the ending that tells the gender.
collisions() proves distinctness on a whole result, by keyed digests of the entities.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, ready_python, table

#: Key of the query; callers of the operator bring their own.
QUERY_KEY = b"surrogate key of the standard query"

# Common given names by gender and script; names that aren't here are found by what stands around them.
GIVEN = {
    ("f", "latin"): "Anna Maria Emma Sofia Laura Julia Clara Elena Sarah Alice Marie Camille Lucia Carmen Greta Ingrid Heidi Nora Emily Jessica Olivia Amelia Isabella Mia Charlotte Sophia Hannah Lisa Linda Susan Karen Nancy Patricia Jennifer Elizabeth Barbara Margaret Fatima Aisha Priya Katarzyna Agnieszka Chiara Giulia Francesca Beatriz Ana Isabel Sophie Chloe Juliette Katharina Sabine Petra Monika".split(),
    ("m", "latin"): "John James Peter Paul Thomas David Daniel Martin Hans Klaus Pierre Jean Luc Carlos Miguel Pablo Diego Robert William Henry Michael Richard Joseph Charles Christopher Matthew Anthony Andrew Joshua Kevin Brian George Edward Liam Noah Oliver Lucas Ahmed Mohammed Ali Omar Rahul Piotr Krzysztof Marco Luca Giovanni Antonio José Javier Alejandro Juan Louis François Jürgen Wolfgang Stefan".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Ирина Наталья Татьяна Светлана Екатерина Юлия Анастасия Людмила".split(),
    ("m", "cyrillic"): "Иван Пётр Алексей Дмитрий Сергей Николай Андрей Михаил Владимир Александр Максим Олег".split(),
    ("f", "greek"): "Μαρία Ελένη Άννα Σοφία Κατερίνα Ιωάννα Βασιλική Δήμητρα".split(),
    ("m", "greek"): "Γιώργος Νίκος Κώστας Δημήτρης Ιωάννης Πέτρος Παναγιώτης Χρήστος".split(),
}
# Forms of address by gender, and phrases that a name follows.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Sir": "m", "Madam": "f", "Herr": "m", "Herrn": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Dr": "", "Prof": "", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f", "Κα": "f"}
PHRASES = ("my name is", "name is", "signed by", "written by", "mein Name ist", "ich heiße", "je m'appelle", "me llamo", "mi nombre es", "меня зовут", "με λένε")
# Letters by script, vowels first; letters that aren't here stay.
LETTERS = {
    "latin": ("aeiouy", "bcdfghjklmnpqrstvwxz"),
    "latin accents": ("áéíóúàèìòùâêîôûäëïöü", "ñçß"),
    "cyrillic": ("аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ"),
    "greek": ("αεηιουω", "βγδζθκλμνξπρστφχψ"),
    "greek accents": ("άέήίόύώ", ""),
}
#: Letters at the end of a name that stay, since they tell its gender.
ENDING = {"latin": 1, "cyrillic": 2, "greek": 2}

EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+\-]*@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)+")
SECRET = re.compile(r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\b[\"']?\s*[=:]\s*[\"']?)([A-Za-z0-9_\-+/.~]{8,})")
ACCESS = re.compile(r"\b((?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_\-]{20,})\b")
NUMBERS = re.compile(
    r"(?<![\w.])(?:(?P<ip>\d{1,3}(?:\.\d{1,3}){3})(?!\.?\d)"
    r"|(?P<card>\d{4}([ \-]?)\d{4}\3\d{4}\3\d{1,7})(?!\d)"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})(?![\-\d]))"
    r"|(?<![\w.])(?P<phone>(?:\+\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}|(?<![\w.])\+\d{1,3}(?:[ .\-]?\d{2,4}){2,5}|(?<![\w.])\d{3}[.\-]\d{3}[.\-]\d{4})(?!\d)"
)
IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")
_TITLE = "|".join(sorted(TITLES, key=len, reverse=True))
_NAME = rf"(?!(?:{_TITLE})\b)[^\W\d_a-zа-яёα-ώß-öø-ÿ][^\W\d_]+(?:[-'’][^\W\d_]+)*"
_GIVEN = sorted({n for names in GIVEN.values() for n in names}, key=lambda n: (-len(n), n))
_KNOWN = frozenset(_GIVEN)
PERSON = re.compile(
    rf"(?P<title>\b(?:{_TITLE})\b\.?[ \t]+(?:Dr\.?[ \t]+|Prof\.?[ \t]+)*)(?P<titled>{_NAME}(?:[ \t]+{_NAME}){{0,2}})"
    rf"|\b(?:(?i:{'|'.join(PHRASES)}))[ \t]+(?P<told>{_NAME}(?:[ \t]+{_NAME}){{0,2}})"
    rf"|\b(?P<given>(?:{'|'.join(_GIVEN)})(?:[ \t]+{_NAME}){{1,2}})"
    rf"|(?P<mailed>{_NAME}[ \t]+{_NAME})(?=[ \t]*[<(][ \t]*(?:mailto:)?[\w.+\-]+@)"
)
#: What PERSON needs in a text, so that others aren't searched.
_HINT = re.compile(rf"\b(?:{'|'.join(sorted({*TITLES, *_GIVEN}, key=len, reverse=True))})\b|(?i:{'|'.join(PHRASES)})|[<(][ \t]*(?:mailto:)?[\w.+\-]+@")
_WORD = re.compile(_NAME)
_DIGITS, _HEX, _SMALL, _LARGE = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CLASS = {c: a for pair in LETTERS.values() for a in pair for c in a}
_CLASS |= {c.upper(): a.upper() for c, a in _CLASS.items() if len(c.upper()) == 1 and c.upper() != c}


def script_of(word: str) -> str:
    name = unicodedata.name(word[0], "")
    return next((s for s in ENDING if name.startswith(s.upper())), "latin")


def _is_hex(text: str) -> bool:
    """Whether a text is a hexadecimal number of eight digits or more, with digits and letters."""
    found = set(text)
    return len(text) >= 8 and found <= set(_HEX) and bool(found & set(_DIGITS)) and not found <= set(_DIGITS)


class Surrogates:
    """The replacement of each entity under a key; equal entities always get equal ones, different ones of a type different ones."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.known: dict[tuple[str, str], str] = {}

    def _number(self, *parts: object) -> int:
        return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"), key=self.key, digest_size=32).digest(), "big")

    def digest(self, kind: str, text: str) -> str:
        """A keyed name of an entity, by which it can be told from others without being known."""
        return f"{self._number('digest', kind, text) >> 128:032x}"

    def permuted(self, kind: str, text: str, alphabets: list[str | None], domain: Callable[[str], bool] | None = None) -> str:
        """The text with its characters of the given alphabets replaced one-to-one among all texts of this form and domain; others stay.

        Where the permutation leaves the domain it is applied again, which keeps it one-to-one.
        """
        at = [k for k, a in enumerate(alphabets) if a]
        if not at:
            return text
        form = "".join(a[:1] + str(len(a)) if a else c for c, a in zip(text, alphabets))
        middle = len(at) // 2
        while True:
            value, size = [0, 0], [1, 1]
            for n, k in enumerate(at):
                half = int(n >= middle)
                value[half] = value[half] * len(alphabets[k]) + alphabets[k].index(text[k])
                size[half] *= len(alphabets[k])
            for turn in range(8):
                half = turn % 2
                value[half] = (value[half] + self._number("feistel", kind, form, turn, value[1 - half])) % size[half]
            out = list(text)
            for n in range(len(at) - 1, -1, -1):
                k, half = at[n], int(n >= middle)
                value[half], digit = divmod(value[half], len(alphabets[k]))
                out[k] = alphabets[k][digit]
            text = "".join(out)
            if domain is None or domain(text):
                return text

    def by_form(self, kind: str, text: str, keep: int = 0) -> str:
        """Digits stay digits, small and large letters stay so, hexadecimal numbers stay hexadecimal; the first `keep` characters stay themselves."""
        if _is_hex(text[keep:]):
            return self.permuted(kind + " hex", text, [None] * keep + [_HEX] * (len(text) - keep), lambda t: _is_hex(t[keep:]))
        alphabets = [_DIGITS if c in _DIGITS else _SMALL if c in _SMALL else _LARGE if c in _LARGE else None for c in text[keep:]]
        return self.permuted(kind, text, [None] * keep + alphabets, lambda t: not _is_hex(t[keep:]))

    def email(self, text: str) -> str:
        """Domains are the same whatever their case, which stays as it is; none of the new ones exists."""
        name, _, domain = text.partition("@")
        new = self.replace("domain", domain.lower(), lambda d: self.permuted("domain", d, [_DIGITS if c in _DIGITS else _SMALL if c in _SMALL else None for c in d]))
        new = "".join(n.upper() if c.isupper() else n for c, n in zip(domain, new))
        return self.by_form("email " + domain.lower(), name) + "@" + new + (".EXAMPLE" if domain.isupper() else ".example")

    def ip(self, text: str) -> str:
        """An address stays one; four numbers that aren't any don't become one."""

        def numbers(t: str) -> list[int] | None:
            parts = t.split(".")
            return [int(p) for p in parts] if len(parts) == 4 and all(str(int(p)) == p and int(p) < 256 for p in parts) else None

        parts = numbers(text)
        if parts is None:
            return self.permuted("numbers", text, [_DIGITS if c in _DIGITS else None for c in text], lambda t: numbers(t) is None)
        left, right = parts[0] << 8 | parts[1], parts[2] << 8 | parts[3]
        for turn in range(8):
            left, right = right, left ^ self._number("ip", turn, right) & 0xFFFF
        return f"{left >> 8}.{left & 255}.{right >> 8}.{right & 255}"

    def card(self, text: str) -> str:
        """The first digit stays; a number with a valid check digit gets one, another number doesn't."""
        digits = [k for k, c in enumerate(text) if c.isdigit()]
        body = self.permuted("card", text[: digits[-1]], [_DIGITS if c in _DIGITS and k else None for k, c in enumerate(text[: digits[-1]])])
        old = (int(text[digits[-1]]) - check_digit(text[: digits[-1]])) % 10
        return body + str((check_digit(body) + old) % 10) + text[digits[-1] + 1 :]

    def phone(self, text: str) -> str:
        country = re.match(r"\+\d{1,3}(?=\D)|\+\d", text)
        return self.by_form("phone", text, country.end() if country else 0)

    def name(self, text: str) -> str:
        """Vowels for vowels, consonants for consonants, in their case and script; the ending stays."""
        parts = re.split(r"([-'’])", text)
        out = []
        for part in parts:
            stay = ENDING[script_of(part)] if part and part[0].isalpha() else 0
            free = max(0, len(part) - stay) if len(part) > stay + 1 else len(part)
            out += [_CLASS.get(c) if k < free else None for k, c in enumerate(part)]
        return self.permuted("name", text, out)

    def replace(self, kind: str, text: str, make: Callable[[str], str]) -> str:
        found = self.known.get((kind, text))
        if found is None:
            found = self.known[kind, text] = make(text)
        return found


def check_digit(text: str) -> int:
    """The Luhn digit that makes the digits of a text valid when put after them."""
    total = 0
    for n, c in enumerate(c for c in reversed(text) if c.isdigit()):
        d = int(c) * (2 if n % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _composed(text: str) -> tuple[str, list[int] | None]:
    """The text in composed form, and where each of its parts begins in the text; None if it is as it was."""
    if text.isascii() or unicodedata.is_normalized("NFC", text):
        return text, None
    out, at, k = [], [], 0
    while k < len(text):
        end = k + 1
        while end < len(text) and (unicodedata.combining(text[end]) or "\u1160" <= text[end] <= "\u11ff"):
            end += 1
        part = unicodedata.normalize("NFC", text[k:end])
        out.append(part)
        at += [k] * len(part)
        k = end
    return "".join(out), at


Span = tuple[int, int, str, str, str]


def pseudonymise(text: str | None, of: Surrogates) -> tuple[str | None, list[Span]]:
    """The text with surrogates, and (begin, end, type, digest, surrogate) of the entities in the original text.

    Of entities that overlap the one of the earlier type here stays: mail addresses, secrets, keys,
    account numbers, other numbers, persons. Entities are looked for in the composed form; what lies
    outside them stays as it was. Time grows with the length of the text alone.
    """
    if not text:
        return text, []
    seen, begins = _composed(text)
    taken, spans = bytearray(len(seen)), []

    def add(kind: str, begin: int, end: int, make: Callable[[str], str]) -> None:
        if begin < end and taken.find(1, begin, end) < 0:
            taken[begin:end] = b"\1" * (end - begin)
            old = seen[begin:end]
            spans.append((begin, end, kind, of.digest(kind, old), of.replace(kind, old, make)))

    if "@" in seen:
        for m in EMAIL.finditer(seen):
            add("email", m.start(), m.end(), of.email)
    for m in SECRET.finditer(seen) if "=" in seen or ":" in seen else ():
        add("secret", m.start(1), m.end(1), lambda s: of.by_form("secret", s))
    for m in ACCESS.finditer(seen):
        add("access_key", m.start(1), m.end(1), lambda s: of.by_form("access", s, 4))
    for m in IBAN.finditer(seen):
        add("iban", m.start(), m.end(), lambda s: of.by_form("iban", s, 2))
    for m in NUMBERS.finditer(seen):
        kind = next(k for k in ("ip", "card", "ssn", "phone") if m[k])
        # A long number with a wrong check digit is no card.
        if kind != "card" or check_digit(m[kind][:-1]) == int(m[kind][-1]):
            add(kind, m.start(kind), m.end(kind), {"ip": of.ip, "card": of.card, "phone": of.phone}.get(kind, lambda s: of.by_form("ssn", s)))
    if _HINT.search(seen):
        for m in PERSON.finditer(seen):
            part = next(k for k in ("titled", "told", "given", "mailed") if m[k])
            for w in _WORD.finditer(m[part]):
                add("person", m.start(part) + w.start(), m.start(part) + w.end(), of.name)
    spans.sort()
    out, at = [], 0
    if begins is not None:
        # From places in the composed text to places in the original.
        ends = [*begins, len(text)]
        spans = [(begins[b], ends[bisect_right(begins, begins[e - 1])] if e - 1 < len(begins) else len(text), *rest) for b, e, *rest in spans]
    for begin, end, *_, new in spans:
        out += [text[at:begin], new]
        at = end
    return "".join([*out, text[at:]]), spans


_ENTITY = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("type", pa.string()), ("digest", pa.string()), ("surrogate", pa.string())])


def pseudonymise_documents(documents: DataFrame, key: bytes, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, text with surrogates, entities (begin, end, type, digest, surrogate, in the original text) and n_entities of every row.

    Null texts stay null and have no entities. Repeated rows stay; texts of any length are taken
    whole; an empty table gives no rows. A kept column can't have a name of the result.
    """
    spark = documents.sparkSession
    ready_python(spark)
    if {"entities", "n_entities"} & set(keep):
        raise ValueError("entities and n_entities are columns of the result")
    kept = [c for c in keep if c != "text"]
    rows = pick(documents, *kept, "text")
    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in kept)

    def run(batches):
        of = Surrogates(key)
        for batch in batches:
            of.known.clear()
            done = [pseudonymise(t, of) for t in batch.column("text").to_pylist()]
            entities = pa.array([[dict(zip(("begin", "end", "type", "digest", "surrogate"), s)) for s in spans] for _, spans in done], pa.list_(_ENTITY))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([t for t, _ in done], pa.string()), entities, pa.array([len(s) for _, s in done], pa.int64())], [*kept, "text", "entities", "n_entities"])

    return rows.mapInArrow(run, f"{kinds}text string, entities array<struct<begin:int,end:int,type:string,digest:string,surrogate:string>>, n_entities long")


def collisions(done: DataFrame) -> DataFrame:
    """type and surrogate of entities that aren't distinct, or digest of those without one surrogate, over a whole result: no rows."""
    each = done.select(F.explode("entities").alias("e")).select("e.type", "e.digest", "e.surrogate").distinct()
    shared = each.groupBy("type", F.col("surrogate").alias("name")).agg(F.countDistinct("digest").alias("n"))
    split = each.groupBy("type", F.col("digest").alias("name")).agg(F.countDistinct("surrogate").alias("n"))
    return shared.union(split).where("n > 1")


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their personal data and secrets replaced."""
    return pseudonymise_documents(table(spark, sf_dir, "documents"), QUERY_KEY)
