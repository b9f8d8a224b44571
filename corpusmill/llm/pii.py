"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Each text is one row and is read in time linear in its length, so no key, source or group of copies matters and nothing
is shuffled. Null text counts as empty. Null doc_id, repeated rows and other columns pass: every input row gives one
output row with its doc_id. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grouped, joined, text_or_empty

#: Base kinds in their listed order, then those that validators and context add.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
SPAN = "kind string, start bigint, end bigint, score double"

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match that fails is never retried inside; since each of these takes the whole run, starting at a run's first digit loses none.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){11,}")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")

#: Score before context, words that raise it and words that lower it when they stand within WINDOW characters.
WINDOW = 60
RULES = {
    "email": (0.9, r"e-?mail|contact|write", r"\bnoreply\b"),
    "ip": (0.6, r"\bips?\b|server|host|address|login", r"version|release|section"),
    "card": (0.8, r"card|visa|master|amex|credit|payment|karte|tarjeta|carte", r"\border|isbn|serial|tracking"),
    "phone": (0.7, r"phone|\btel|call|mobile|fax|telefon|tel[eé]fono", r"\border|serial"),
    "iban": (0.6, r"iban|bank|account|konto|cuenta|compte", r"serial|\bpart\b"),
    "ssn": (0.4, r"\bssn\b|social security", r"\bpart\b|serial"),
}
_CONTEXT = {k: (s, re.compile(up, re.I), re.compile(down, re.I)) for k, (s, up, down) in RULES.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(code: str) -> bool:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: each has one @, so one look at every @ finds them, and the local part reaches back to what went before."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(_LOCAL))
        low = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            low = m.end()
        at = text.find("@", low)


def proposals(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) that passed their validators."""
    for a, b in emails(text):
        yield a, b, "email"
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            yield m.start(), m.end(), "ip"
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if len(digits) <= 19 and luhn(digits):
            yield m.start(), m.end(), "card"
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(m[0])) <= 15:
            yield m.start(), m.end(), "phone"
    for m in _IBAN.finditer(text):
        found = m[0]
        while len(found) > 14:  # a word in capitals may follow the number
            if len(code := found.replace(" ", "")) <= 34 and mod97(code):
                yield m.start(), m.start() + len(found), "iban"
                break
            if " " not in found:
                break
            found = found[: found.rindex(" ")]
    for m in _SSN.finditer(text):
        yield m.start(), m.end(), "ssn"


def scored(text: str, threshold: float) -> list[tuple[int, int, str, float]]:
    """All base spans, and added ones that reach the threshold, by start and kind."""
    out = []
    for start, end, kind in proposals(text):
        score, up, down = _CONTEXT[kind]
        near = f"{text[max(0, start - WINDOW) : start]} {text[end : end + WINDOW]}"
        score += 0.3 * bool(up.search(near)) - 0.3 * bool(down.search(near))
        if kind in BASE or score >= threshold:
            out.append((start, end, kind, round(min(1.0, max(0.0, score)), 2)))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def redacted(text: str, spans: list[tuple[int, int, str, float]]) -> str:
    """Each span replaced by its kind; of spans that overlap, the first names the whole."""
    out, at, low, name = [], 0, None, ""
    for start, end, kind, _ in spans:
        if low is not None and start < high:
            high = max(high, end)
            continue
        if low is not None:
            out += [text[at:low], f"<{name}>"]
            at = high
        low, high, name = start, end, kind.upper()
    if low is not None:
        out += [text[at:low], f"<{name}>"]
        at = high
    return "".join([*out, text[at:]])


def _spans(found: list[list[tuple]]) -> pa.Array:
    offsets = [0]
    for f in found:
        offsets.append(offsets[-1] + len(f))
    flat = [s for f in found for s in f]
    cols = [pa.array([s[2] for s in flat], pa.string()), pa.array([s[0] for s in flat], pa.int64()), pa.array([s[1] for s in flat], pa.int64()), pa.array([s[3] for s in flat], pa.float64())]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(cols, ["kind", "start", "end", "score"]))


def find_pii(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, spans): one row for each row of docs."""

    def run(batches):
        for b in (part for whole in batches for part in grouped(whole, 1)):
            found = [scored(t, threshold) if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), _spans(found)], ["doc_id", "spans"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {_type(docs)}, spans array<struct<{SPAN.replace(' ', ':').replace(',:', ',')}>>")


def redact_pii(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs with its columns, personal data in text replaced by <KIND>. Null text stays null."""
    names = [f.name for f in docs.schema.fields]
    at = names.index("text")

    def run(batches):
        for b in (part for whole in batches for part in grouped(whole, at)):
            texts = [t and redacted(t, scored(t, threshold)) for t in b.column(at).to_pylist()]
            cols = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, docs.schema)


def _type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of the contract, from what find_pii returns."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return find_pii(docs).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        *[count(k).alias(f"n_{k}") for k in KINDS[4:]], F.array_max(F.transform("spans", lambda s: s["score"])).alias("max_score"),
    )
