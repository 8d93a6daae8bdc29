"""Personal data: patterns propose, checksums confirm, nearby words adjust the score.

Base kinds are email, ip, card (Luhn) and phone.  The method adds iban (mod 97) and ssn (area
rules; reported only where context words lift its score).  Every span has a score: that of
its kind, raised by context words before it and lowered by words that name something else.

Texts are scanned whole, inside Arrow batches.  Patterns start only where a run starts, which
keeps scanning linear in very long runs of digits or letters and finds the same spans.

Defined results: null or empty text has no span; kinds may overlap and all stay; rows with the
same id are scanned apart; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Kinds in the order of their listing, with their scores without context.
SCORES = {"email": 0.9, "ip": 0.5, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
#: Words near a span that raise or lower its score.
RAISE = {
    "email": ("email", "e-mail", "mail", "contact"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "credit", "visa", "mastercard", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "whatsapp"),
    "iban": ("iban", "account", "bank", "bic", "swift"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
}
LOWER = ("version", "isbn", "example", "order", "part", "serial", "build", "section")
STEP, LEAST, NEAR = 0.3, 0.5, 40

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9_])")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = int(c) * (1 + n % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(text: str) -> bool:
    text = text.replace(" ", "")
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Grow each address from its @: the local part is the run before it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
        at = text.find("@", at + 1)


def spans_of(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of confirmed spans, in no order."""
    out = [(a, "email", b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        parts = [x.lstrip("0") or "0" for x in m[0].split(".")]  # zeros before a number may be many
        if all(len(x) < 4 and int(x) <= 255 for x in parts):
            out.append((m.start(), "ip", m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), "card", m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), "phone", m.end()))
    out += [(m.start(), "iban", m.end()) for m in _IBAN.finditer(text) if mod97(m[0])]
    out += [(m.start(), "ssn", m.end()) for m in _SSN.finditer(text) if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000"]
    return out


def score_of(text: str, start: int, kind: str, end: int) -> float:
    near = set(re.findall(r"[a-z-]+", text[max(0, start - NEAR) : start].lower()))
    up, down = any(w in near for w in RAISE[kind]), any(w in near for w in LOWER)
    return min(1.0, max(0.0, SCORES[kind] + STEP * (up - down)))


def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = list(SCORES)
    base, order = kinds[:4], {k: n for n, k in enumerate(kinds)}
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            found = sorted(spans_of(text or ""), key=lambda s: (s[0], order[s[1]], s[2]))
            scored = [(s, score_of(text, *s)) for s in found]
            scored = [(s, x) for s, x in scored if s[1] in base or x >= LEAST]
            named = [(s[1], f"{s[1]}:{s[0]}:{s[2]}") for s, _ in scored]
            plain = ",".join(n for k, n in named if k in base)
            rows.append([*(sum(k == b for k, _ in named) for b in base), hashlib.sha256(plain.encode()).hexdigest(), ",".join(n for _, n in named), max((x for _, x in scored), default=0.0)])
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *(f"n_{b}" for b in base), "base_sha256", "spans", "pii_score"])


def pii_report(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """One row for each row: doc_id, counts of base kinds, base_sha256, spans, pii_score (the
    highest score of its spans, 0 without any)."""
    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    kind = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, pii_score double"
    return rows.mapInArrow(report, kind)
