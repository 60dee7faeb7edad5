"""Personal data by anchors: find the rare characters and cues first, then read around them.

One Aho-Corasick pass over a text finds at-signs, plus signs, digits, address schemes and
identifier cues. A small parser for each kind reads the boundaries from the anchor and checks
them. For the four base kinds the result is exactly that of a leftmost, non-overlapping search
with the patterns below, because every match holds its anchor at a known place.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pagemart.llm.common import documents

#: The kinds in their order; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "url", "iban", "account")
BASE_KINDS = KINDS[:4]

#: Boundaries of the kinds, read from their anchor on.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]+")
IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL = re.compile(r"(?:www\.)?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]{1,5})?(?:[/?#][^\s<>\"']*)?")
IBAN = re.compile(r"[\s:.]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")

#: What may stand between a cue and its value, and the values of each cue. Cues
#: without an entry have the last one only, which the others fall back to.
FILLER = r"(?:[\s:=#\"'_-]{0,6}(?i:number|num|no|nr|id|is|was|key|code)\b\.?){0,3}[\s:=#\"']{1,6}"
DATE = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")
SSN = re.compile(FILLER + r"(([0-9]{3})([\x20-]?)([0-9]{2})\3([0-9]{4}))(?![A-Za-z0-9_]|-[A-Za-z0-9])")
PASSPORT = re.compile(FILLER + r"([A-Za-z0-9]{6,9})(?![A-Za-z0-9_]|-[A-Za-z0-9])")
ACCOUNT = re.compile(
    FILLER + r"([0-9]{4}(?:\x20[0-9]{4})+(?:\x20[0-9]{1,4})?|[A-Za-z0-9_-]{6,64})(?![A-Za-z0-9_-])"
)
VALUE = re.compile(FILLER + r"([A-Za-z0-9_-]{12,64})(?![A-Za-z0-9_-])")

#: Cues, each in small letters, capitals and with a capital first.
SCHEMES = ("http://", "https://", "ftp://", "www.")
ACCOUNT_CUES = ("account", "token", "password", "secret", "api_key", "apikey", "passport", "ssn")


def automaton() -> ahocorasick.Automaton:
    cues = {"@": ("email", 1), "+": ("phone", 1)}
    cues |= {d: ("digit", 1) for d in "0123456789"}
    for kind, texts in (("url", SCHEMES), ("iban", ("iban",)), ("account", ACCOUNT_CUES)):
        for cue in texts:
            cues |= {form: (kind, len(cue)) for form in (cue, cue.upper(), cue.capitalize())}
    found = ahocorasick.Automaton()
    for cue, value in cues.items():
        found.add_word(cue, value)
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def octet(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def iban_valid(text: str) -> bool:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _digits(text: str) -> int:
    return sum("0" <= c <= "9" for c in text)


def cue_value(cue: str, text: str, at: int) -> re.Match | None:
    """The match whose first group is the value of a cue that ends at `at`, if there is one."""
    cue = cue.lower()
    if cue == "ssn" and (m := SSN.match(text, at)):
        if m[2] not in ("000", "666") and m[4] != "00" and m[5] != "0000":
            return m
    if cue == "passport" and (m := PASSPORT.match(text, at)) and _digits(m[1]) >= 4:
        return m
    if cue == "account" and (m := ACCOUNT.match(text, at)):
        if _digits(m[1]) >= 6 and not DATE.fullmatch(m[1]):
            return m
    m = VALUE.match(text, at)
    return m if m and _digits(m[1]) >= 4 else None


def find_spans(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every span, by start and then kind; code points, end exclusive."""
    spans = []
    after = dict.fromkeys((*KINDS, "run"), 0)  # per kind: where the next match may start
    for last, (kind, length) in anchors.iter(text):
        start = last + 1 - length
        if kind == "digit":
            if start >= after["run"]:
                # All starts inside one run of digits agree on whether an address follows.
                after["run"] = DIGITS.match(text, start).end()
                if start >= after["ip"] and (m := IP.match(text, start)):
                    after["ip"] = m.end()
                    if all(octet(p) for p in m.groups()):
                        spans.append((start, m.end(), "ip"))
            if start >= after["card"] and (m := CARD.match(text, start)):
                after["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    spans.append((start, m.end(), "card"))
        elif kind == "email":
            left = start
            while left > after["email"] and text[left - 1] in LOCAL:
                left -= 1
            if left < start and (m := DOMAIN.match(text, start + 1)):
                after["email"] = m.end()
                spans.append((left, m.end(), "email"))
        elif start < after[kind]:
            continue
        elif kind == "phone":
            if m := PHONE.match(text, start):
                after["phone"] = m.end()
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    spans.append((start, m.end(), "phone"))
        elif kind == "url":
            host = last + 1 if text[last] == "/" else start
            if host == start and start and text[start - 1].isalnum():
                continue  # "www." inside a word
            if m := URL.match(text, host):
                end = host + len(m[0].rstrip(".,;:!?)]}"))
                after["url"] = m.end()
                spans.append((start, end, "url"))
        elif kind == "iban":
            if (m := IBAN.match(text, last + 1)) and iban_valid(m[1]):
                after["iban"] = m.end()
                spans.append((*m.span(1), "iban"))
        elif m := cue_value(text[start : last + 1], text, last + 1):
            after["account"] = m.end()
            spans.append((*m.span(1), "account"))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def span_list(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, spans as array of structs) of every document.

    A null or empty text has no spans. Repeated rows each get their own equal row, a null
    doc_id is allowed, further columns are ignored, an empty table gives no rows. The work is
    linear in the text, so very long texts are read whole.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            found = [
                [{"kind": k, "start": s, "end": e} for s, e, k in find_spans(text.as_py() or "", anchors)]
                for text in batch["text"]
            ]
            yield pa.record_batch([batch["doc_id"], pa.array(found, kind)], ["doc_id", "spans"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, "
    schema += "spans array<struct<kind:string,start:int,end:int>>"
    return docs.select("doc_id", "text").mapInArrow(read, schema)


def span_digest(found: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and the list of all spans, from the spans."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for spans in batch["spans"].to_pylist():
                spans = [(s["start"], s["end"], s["kind"]) for s in spans]
                base = [s for s in spans if s[2] in BASE_KINDS]
                row = {f"n_{k}": sum(s[2] == k for s in base) for k in BASE_KINDS}
                row["base_sha256"] = hashlib.sha256(span_list(base).encode()).hexdigest()
                rows.append(row | {"spans": span_list(spans)})
            layout = pa.schema([(f"n_{k}", pa.int64()) for k in BASE_KINDS])
            layout = layout.append(pa.field("base_sha256", pa.string())).append(pa.field("spans", pa.string()))
            yield pa.RecordBatch.from_pylist(rows, schema=layout).add_column(0, "doc_id", batch["doc_id"])

    counts = ", ".join(f"n_{k} long" for k in BASE_KINDS)
    schema = f"doc_id {found.schema['doc_id'].dataType.simpleString()}, {counts}"
    return found.mapInArrow(digest, f"{schema}, base_sha256 string, spans string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(find_personal_data(documents(spark, sf_dir)))
