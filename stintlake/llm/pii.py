"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Base kinds (email, ip, card, phone) follow fixed patterns, leftmost and without overlap per
kind; a match that fails its check is dropped and not retried. They are always kept. Further
kinds (iban, ssn, local_phone) are kept when their score, after context, reaches ``threshold``
and they overlap no base span.

Patterns are linear in the text (an address is found from its ``@`` outwards, digit groups
start only where a run of digits starts); spans are sorted, and overlaps are found by bisection.

Defined results: null or empty text has no spans; offsets are code points, end exclusive; spans of the same start stand in
the order of their kinds; rows that repeat an id are read each by its own text; an empty table has no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# fixed values: kinds in the order that breaks ties of the same start
BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("iban", "ssn", "local_phone")
RANK = {kind: n for n, kind in enumerate(BASE_KINDS + EXTRA_KINDS)}

# fixed values: prior score of a kind and the words near a span that raise it
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.85, "phone": 0.7, "iban": 0.85, "ssn": 0.4, "local_phone": 0.4}
CONTEXT = {
    "email": ("mail", "contact", "correo", "write to"),
    "ip": ("ip", "address", "server", "host", "adresse"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security"),
    "local_phone": ("phone", "call", "tel", "mobile", "fax"),
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9])")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(_DOUBLED[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def mod97(iban: str) -> bool:
    code = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = start < at and _DOMAIN.match(text, at + 1)
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def _base(text: str) -> list[tuple[str, int, int]]:
    spans = [("email", *s) for s in _emails(text)]
    if not _DIGIT.search(text):
        return spans
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split(".")):
            spans.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(map(str.isdigit, m.group())) <= 15:
            spans.append(("phone", *m.span()))
    return spans


def _score(kind: str, text: str, start: int, end: int, window: int) -> float:
    near = f"{text[max(0, start - window):start]} {text[end:end + window]}".lower()
    hits = sum(word in near for word in CONTEXT[kind])
    return min(1.0, PRIOR[kind] + 0.15 * min(hits, 2))


def _merged(spans: list[tuple]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint stretches that the spans cover, in order."""
    starts, ends = [], []
    for start, end in sorted((s, e) for _, s, e, _ in spans):
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start), ends.append(end)
    return starts, ends


def find_spans(text: str | None, threshold: float = 0.5, window: int = 40) -> list[tuple[str, int, int, float]]:
    """All spans as (kind, start, end, score), by start and then kind."""
    if not text:
        return []
    base = _base(text)
    found = [(k, s, e, _score(k, text, s, e, window)) for k, s, e in base]
    if _DIGIT.search(text):
        for kind, pattern, check in (("iban", _IBAN, mod97), ("ssn", _SSN, None), ("local_phone", _LOCAL_PHONE, None)):
            starts, ends = _merged(found)  # matches of one kind don't overlap
            for m in pattern.finditer(text):
                start, end = m.span()
                before = bisect_left(starts, end) - 1
                if (check is None or check(m.group())) and (before < 0 or ends[before] <= start):
                    score = _score(kind, text, start, end, window)
                    if score >= threshold:
                        found.append((kind, start, end, score))
    return sorted(found, key=lambda x: (x[1], RANK[x[0]]))


def detect_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: id and ``spans``, an array of (kind, start, end, score)."""
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in find_spans(t.as_py(), threshold)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(span))], names=["id", "spans"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>")


def joined(spans: list[tuple], kinds: tuple[str, ...] | None = None) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, *_ in spans if kinds is None or k in kinds)


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def mask(text: str, spans: list[tuple]) -> str:
    """The text with each span replaced by its kind in brackets; overlaps keep the first span."""
    out, at = [], 0
    for kind, start, end, *_ in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
            at = end
    return "".join([*out, text[at:]])
