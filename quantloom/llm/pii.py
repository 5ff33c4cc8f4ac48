"""Personal data: regular expressions propose spans, checksums confirm them, and nearby context words adjust their score.

Kinds, in the order in which equal starts are listed: email, ip, card, phone (the base kinds: found leftmost without overlap, failing
matches dropped, every other one kept whatever its score), then iban (mod-97) and national (a three-part number that only counts near
a word that says so).  Offsets are code points, ends exclusive.

Defined results: a null or empty text has no spans; texts of any length are scanned whole; repeated rows are judged each on its own;
an empty table gives an empty result; other columns pass through `redacted` untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .decontaminate import replaced

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "national")
#: Score of a proposed span of each kind, and of one that its validator confirms.
PRIOR = {"email": (0.9, 0.9), "ip": (0.5, 0.6), "card": (0.3, 0.8), "phone": (0.5, 0.6), "iban": (0.2, 0.9), "national": (0.4, 0.4)}
#: Code points before and after a span in which context words count, and what one does to the score.
NEAR, STEP, THRESHOLD = 40, 0.3, 0.6

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?")
_NATIONAL = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
#: Words that raise a kind's score, and words that lower any; ASCII word bounds, either case.
WORDS = {
    "email": "mail|e-mail|contact|write",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|credit|debit|payment|amex",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|bank|account|transfer|bic",
    "national": "ssn|social security|national id|passport|tax",
}
AGAINST = "version|isbn|order|part no|serial|example"
_FOR = {k: re.compile(rf"\b(?:{w})\b", re.I | re.A) for k, w in WORDS.items()}
_AGAINST = re.compile(rf"\b(?:{AGAINST})\b", re.I | re.A)
_DIGIT = re.compile("[0-9]")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """The check sum of card numbers; digits only."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """The check of account numbers: country code and check digits go last, letters count from 10."""
    turned = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern local@domain(.domain)+ would match leftmost, but led by the @ signs: linear in long runs without one."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern of four dotted numbers would match leftmost, each four of a chain; a run of digits is read once."""
    for m in _DOTTED.finditer(text):
        at, parts = m.start(), m[0].split(".")
        for k in range(0, len(parts) - 3, 4):
            size = sum(map(len, parts[k : k + 4])) + 3
            yield at, at + size
            at += size + 1


def _proposed(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """Kind, bounds, and whether the validator confirms."""
    for a, b in _emails(text):
        yield "email", a, b, True
    if not _DIGIT.search(text):
        return
    for a, b in _addresses(text):
        yield "ip", a, b, all(map(_small, text[a:b].split(".")))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = _digits(m[0])
            yield "card", m.start(), m.end(), 12 <= len(d) <= 19 and luhn(d)
    for m in _PHONE.finditer(text):
        yield "phone", m.start(), m.end(), 9 <= len(_digits(m[0])) <= 15
    for m in _IBAN.finditer(text):
        code = m[0].replace(" ", "")
        yield "iban", m.start(), m.end(), 15 <= len(code) <= 34 and mod97(code)
    for m in _NATIONAL.finditer(text):
        yield "national", m.start(), m.end(), True


def spans(text: str | None, threshold: float = THRESHOLD) -> list[Span]:
    """Every span: the base kinds that their checks leave, and of the others those whose score reaches the threshold."""
    out = []
    for kind, a, b, confirmed in _proposed(text or ""):
        if not confirmed:
            continue
        near = text[max(0, a - NEAR) : a] + " " + text[b : b + NEAR]
        score = PRIOR[kind][1] + STEP * bool(_FOR[kind].search(near)) - STEP * bool(_AGAINST.search(near))
        score = round(min(1.0, max(0.0, score)), 3)
        if kind in BASE or score >= threshold:
            out.append(Span(kind, a, b, score))
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind)))


def redact(text: str | None) -> str | None:
    """text with each span replaced by its kind in brackets; of spans that overlap, the first, which grows to cover the others."""
    if not (found := spans(text)):
        return text
    out, at = [], 0
    joined: list[list] = []
    for s in found:
        if joined and s.start < joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], s.end)
        else:
            joined.append([s.start, s.end, s.kind])
    for a, b, kind in joined:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def listed(found: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in found)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, "text"):
        found = [spans(t) for t in common.texts(batch, "text")]
        counts = [pa.array([sum(s.kind == k for s in f) for f in found], pa.int64()) for k in BASE]
        base = [hashlib.sha256(listed([s for s in f if s.kind in BASE]).encode()).hexdigest() for f in found]
        scores = [",".join(f"{s.score:g}" for s in f) for f in found]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *counts, pa.array(base, pa.string()), pa.array([listed(f) for f in found], pa.string()), pa.array(scores, pa.string())], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "scores"])


def found(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: counts of the base kinds, the digest of the base spans, all spans and their scores."""
    return common.mapped(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), _find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string")


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with their spans masked; n_chars, if there, is counted anew where the text changed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, text):
            yield replaced(batch, text, [redact(t) for t in common.texts(batch, text)])

    return common.mapped(docs, run, docs.schema)
