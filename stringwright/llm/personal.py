"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The kinds in order, their patterns and limits.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
EMAIL_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: The same matches as without look-behind and possessive repeats, which keep long runs of digits linear.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Further kinds of the method, after the base ones: bank account numbers and numbers with a check digit
#: that only count where words nearby speak for them.
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")

#: Score of a proposed span by kind, before its context.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.3}
#: Words within ``NEAR`` characters before or after that raise or lower the score by ``STEP``.
SPEAKS_FOR = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "transfer", "bic", "swift"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
}
SPEAKS_AGAINST = ("version", "isbn", "order", "invoice", "example", "test", "sample")
NEAR = 40
STEP = 0.3
#: An added span is reported from this score on; base spans always are.
ACCEPT = 0.5

_WORD = re.compile(r"[A-Za-z]+")


def luhn(digits: str) -> bool:
    """Whether every second digit from the right, doubled and cast out, completes the sum to tens."""
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Whether the moved and lettered account number leaves 1 by 97."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of ``EMAIL``, each found from its ``@``."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        match = EMAIL_AT.match(text, at) if start < at else None
        if match:
            end = match.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def proposed(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans by kind in order, then by start."""
    yield from (("email", a, b) for a, b in emails(text))
    for m in IP.finditer(text):
        parts = (p.lstrip("0") or "0" for p in m[0].split("."))
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                yield "phone", m.start(), m.end()
    for m in IBAN.finditer(text):
        account = m[0].replace(" ", "")
        if 15 <= len(account) <= 34 and mod97(account):
            yield "iban", m.start(), m.end()
    for m in SSN.finditer(text):
        yield "ssn", m.start(), m.end()


def score(text: str, kind: str, start: int, end: int) -> float:
    """Prior of the kind, moved by the words around the span, between 0 and 1."""
    around = text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]
    near = {w.lower() for w in _WORD.findall(around)}
    value = PRIOR[kind] + STEP * (not near.isdisjoint(SPEAKS_FOR[kind])) - STEP * (not near.isdisjoint(SPEAKS_AGAINST))
    return min(1.0, max(0.0, value))


def spans_of(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of a whole text by kind, then start; code points, end exclusive."""
    if not text:
        return []
    scored = [(k, a, b, score(text, k, a, b)) for k, a, b in proposed(text)]
    return [s for s in scored if s[0] in KINDS[:4] or s[3] >= ACCEPT]


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and its spans, array<struct<kind, start, end, score>>, for every row.

    Email, ip, card (Luhn) and phone are always reported; iban (mod 97) and ssn from the score
    ``ACCEPT`` on. Null and empty texts have no spans; a null doc_id is passed on; repeated rows are
    answered each; other columns are ignored.
    """
    schema = "doc_id long, spans array<struct<kind: string, start: int, end: int, score: double>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("kind", "start", "end", "score")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [[dict(zip(names, s)) for s in spans_of(t.as_py())] for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(find, schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts and joined spans of ``personal_data``; the base spans as a hash."""
    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:4]))
    return found.select(
        "doc_id",
        *[count(k) for k in KINDS[:4]],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
