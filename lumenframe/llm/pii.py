"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
BASE_KINDS = KINDS[:4]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A match that starts inside a run of digits could only repeat what failed at the run's first digit.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

# Words near a span that speak for its kind, or against it.
CONTEXT = {
    "email": "email mail e-mail contact correo courriel",
    "ip": "ip address server host adresse",
    "card": "card visa mastercard credit payment karte carte tarjeta",
    "phone": "phone tel call mobile fax telefon telephone telefono",
    "iban": "iban bank account konto compte cuenta",
    "ssn": "ssn social security",
}
AGAINST = "example sample version order invoice isbn serial"
# Score of a span before its context is read.
START_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
_FOR = {k: frozenset(v.split()) for k, v in CONTEXT.items()}
_NOT = frozenset(AGAINST.split())
_NEAR_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the local part, @ and a domain with a dot, leftmost and without overlap, in linear time.

    A match can only start at the earliest free character of the run of local characters in front of an @.
    """
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _card(s: str) -> bool:
    d = _digits(s)
    return 12 <= len(d) <= 19 and luhn(d)


def proposed(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of spans whose form and checksum hold."""
    for a, b in emails(text):
        yield "email", a, b
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if _card(m[0]):
            yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                yield "phone", *m.span()
    for m in _IBAN.finditer(text):
        compact = m[0].replace(" ", "")
        if 15 <= len(compact) <= 34 and mod97(compact):
            yield "iban", *m.span()
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield "ssn", *m.span()


def score(text: str, kind: str, start: int, end: int, reach: int = 40) -> float:
    near = {w.lower() for w in _NEAR_WORD.findall(text[max(0, start - reach) : start] + " " + text[end : end + reach])}
    return max(0.0, min(1.0, START_SCORE[kind] + 0.2 * bool(near & _FOR[kind]) - 0.2 * bool(near & _NOT)))


def spans(text: str | None, least_added: float = 0.5) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind. Base kinds always stay; others need a score of least_added."""
    found = [(k, a, b, score(text, k, a, b)) for k, a, b in proposed(text)] if text else []
    return sorted((x for x in found if x[0] in BASE_KINDS or x[3] >= least_added), key=lambda x: (x[1], KINDS.index(x[0])))


def find(docs: DataFrame) -> DataFrame:
    """doc_id and pii, an array of (kind, start, stop, score, value), for every row of docs.

    Places are code points, stop is exclusive. A null or empty text has no spans; repeated rows, null doc_ids and
    ties change nothing, an empty table gives no rows, columns other than doc_id and text are ignored.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column("text"):
                text = x.as_py()
                rows.append([{"kind": k, "start": a, "stop": b, "score": s, "value": text[a:b]} for k, a, b, s in spans(text)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(span))], ["doc_id", "pii"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, pii array<struct<kind:string,start:int,stop:int,score:double,value:string>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts and span strings of find()'s rows."""
    said = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    of = lambda *kinds: F.filter("pii", lambda s: s["kind"].isin(*kinds))
    counts: list[Column] = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(said(of(*BASE_KINDS)), 256).alias("base_sha256"), said(F.col("pii")).alias("spans"), F.size(F.filter("pii", lambda s: ~s["kind"].isin(*BASE_KINDS))).cast("long").alias("n_added"))
