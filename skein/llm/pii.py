"""Personal data: patterns propose spans, checksums and ranges confirm them, words nearby adjust the score.

Base kinds are email, ip, card (Luhn) and phone; the method adds iban (its country's length, and mod-97). Every pattern is scanned in linear time:
a kind without its telling character in a text is skipped, repeats are possessive where giving back cannot help, and a
search never starts inside a run that has failed as a whole.

A span's score is its kind's base score, raised when a context word stands within CONTEXT characters before or after,
and lowered when a word there speaks of something else. The score is reported and drops no span.

Defined cases: null text is empty and has no spans; spans of a kind never overlap, spans of different kinds may; repeated
rows are scanned each, as are rows without an id; the longest texts are scanned whole; an empty table gives no rows;
extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import only, slices, table, texts_of

KINDS = ("email", "ip", "card", "phone", "iban")
BASE = KINDS[:4]
CONTEXT, RAISED, LOWERED = 40, 0.2, 0.3
BASE_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.5, "iban": 0.8}
CONTEXT_WORDS = {
    "email": frozenset("mail email e mails contact write address correo courriel adresse".split()),
    "ip": frozenset("ip ips ipv4 host hosts server servers addr address client login".split()),
    "card": frozenset("card cards visa mastercard credit payment paid karte carte tarjeta".split()),
    "phone": frozenset("phone phones tel telephone call calls mobile cell fax telefon telefono llamar".split()),
    "iban": frozenset("iban bank account accounts konto compte cuenta transfer".split()),
}
#: Words that make a number something else.
AGAINST = frozenset("version versions isbn order orders invoice build".split())

DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2}[0-9]{2}(?= ?[A-Za-z0-9])")
#: Characters of an IBAN by country, after the public registry of the standard.
IBAN_CHARS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23,
    "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18,
    "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19,
    "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
NEAR_WORD = re.compile(r"[^\W\d_]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of local@domain.part: each @ is tried once, with the longest local part free."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            yield m.span()


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            yield m.span()


def mod97(code: str) -> bool:
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """As many letters and digits as the country's numbers have, single spaces between groups of four, that pass mod-97."""
    at = 0
    while m := IBAN.search(text, at):
        at = m.start() + 2
        chars, end, spaced = IBAN_CHARS.get(m[0][:2].upper(), 0), m.end(), text[m.end()] == " "
        if spaced:
            end += chars - 4 + -(-(chars - 4) // 4)
        else:
            end += chars - 4
        code = text[m.start() : end]
        if not chars or len(code) < end - m.start() or text[end : end + 1].isalnum():
            continue
        plain = "".join(code.split(" ")) if spaced and all(code[k] == " " for k in range(4, len(code), 5)) else code
        if len(plain) == chars and plain.isascii() and plain.isalnum() and mod97(plain):
            yield m.start(), end
            at = end


def score(text: str, kind: str, start: int, end: int) -> float:
    near = {w.lower() for w in NEAR_WORD.findall(text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT])}
    out = BASE_SCORE[kind] + RAISED * bool(near & CONTEXT_WORDS[kind]) - LOWERED * bool(near & AGAINST)
    return round(min(1.0, max(0.0, out)), 2)


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind as listed, then start; code points, end exclusive."""
    text = text or ""
    tests = (("email", "@" in text, emails), ("ip", "." in text, ips), ("card", True, cards), ("phone", "+" in text, phones), ("iban", True, ibans))
    return [(kind, a, b, score(text, kind, a, b)) for kind, may, scan in tests if may for a, b in scan(text)]


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, score>>, base_sha256, listed) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [find(t) for t in texts_of(part)]
                said = [[f"{k}:{a}:{b}" for k, a, b, _ in x] for x in found]
                base = [hashlib.sha256(",".join(s for s, x in zip(row, own) if x[0] in BASE).encode()).hexdigest() for row, own in zip(said, found)]
                rows = [[{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in x] for x in found]
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(rows, kind), pa.array(base), pa.array([",".join(x) for x in said])], ["doc_id", "spans", "base_sha256", "listed"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>, base_sha256 string, listed string")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, BASE), "base_sha256", F.col("listed").alias("spans"), F.col("spans.score").alias("scores"))
