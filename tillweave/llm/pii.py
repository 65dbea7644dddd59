"""Personal data: patterns propose spans, checksums confirm them, nearby words move the score.

Base kinds are proposed by fixed patterns, leftmost and not overlapping within a kind; a proposal
that fails its check is dropped and not retried. Further kinds (IBAN by mod 97, social security
numbers, secrets) are added where they do not overlap a base span; they need a score of at least
`LEAST` after the words around them have been weighed. Base spans stay at any score.

Defined cases: NULL and empty texts have no spans; repeated documents are read one by one; offsets
are code points with the end exclusive; other columns are passed through by the operator.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tillweave.llm.words import fresh, pieces

BATCH_BYTES = 4 << 20
LEAST = 0.5
REACH = 40  # characters before a span in which words count

# The base patterns.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Runs of digits with single dots between, taken as a whole and never given back; four make an ip.
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

KINDS = ["email", "ip", "card", "phone", "iban", "ssn", "secret"]
BASE = KINDS[:4]

_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-f]{40}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9])")
_MANY = re.compile(r"[0-9](?:[\x20-]?[0-9]){13}")

#: What each kind starts from, and the words nearby that raise or lower it.
START = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "secret": 0.4}
RAISE = {
    "email": ("mail", "contact"), "ip": ("ip", "address", "host", "server"), "card": ("card", "visa", "payment"), "phone": ("phone", "call", "tel", "mobile"),
    "iban": ("iban", "account", "bank"), "ssn": ("ssn", "social", "security"), "secret": ("token", "key", "secret", "password"),
}
LOWER = {"ip": ("version", "release"), "card": ("order", "isbn"), "phone": ("order", "invoice"), "ssn": ("part", "serial"), "secret": ("commit", "sha", "checksum")}


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def mod97(iban: str) -> bool:
    """An IBAN's check: country and check digits moved to the end, letters as 10 to 35."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The e-mail pattern, found from each `@` backwards: its local part is the run of allowed
    characters before the `@`, at most back to the previous match."""
    last = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            last = m.end()
            yield start, last


def ips(text: str) -> Iterator[tuple[int, int]]:
    """The ip pattern, leftmost and not overlapping: each four neighbours of a chain of digit runs."""
    for m in DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x := p.lstrip("0")) <= 3 and int(x or "0") <= 255 for p in four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    if "@" in text:
        out += [(s, e, "email") for s, e in emails(text)]
    if text.count(".") >= 3:
        out += [(s, e, "ip") for s, e in ips(text)]
    if _MANY.search(text):
        out += [(m.start(), m.end(), "card") for m in CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return out


def score(text: str, start: int, kind: str) -> float:
    near = set(re.findall(r"[a-z]+", text[max(0, start - REACH) : start].lower()))
    got = START[kind] + 0.25 * any(w in near for w in RAISE[kind]) - 0.25 * any(w in near for w in LOWER.get(kind, ()))
    return round(min(1.0, max(0.0, got)), 2)


def spans(text: str | None) -> list[tuple[int, int, str, float]]:
    """All spans by start, then kind as listed."""
    if not text:
        return []
    out = base_spans(text)
    taken = sorted(out)
    more = [(m.start(), m.end(), "iban") for m in _IBAN.finditer(text) if 15 <= len(c := m[0].replace(" ", "")) <= 34 and mod97(c)]
    more += [(m.start(), m.end(), "ssn") for m in _SSN.finditer(text) if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000"]
    more += [(m.start(), m.end(), "secret") for m in _SECRET.finditer(text)]
    more = [x for x in more if score(text, x[0], x[2]) >= LEAST]
    if more and taken:  # sweep: what overlaps a base span is left out
        edge, k, free = 0, 0, []
        for x in sorted(more):
            while k < len(taken) and taken[k][0] < x[1]:
                edge = max(edge, taken[k][1])
                k += 1
            if edge <= x[0]:
                free.append(x)
        more = free
    order = {kind: k for k, kind in enumerate(KINDS)}
    return [(s, e, kind, score(text, s, kind)) for s, e, kind in sorted([*out, *more], key=lambda x: (x[0], order[x[2]], x[1]))]


SPANS = T.ArrayType(T.StructType([
    T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("score", T.DoubleType()),
]))


def with_spans(docs: DataFrame, text: str = "text", name: str = "pii_spans") -> DataFrame:
    """`docs` with an array column of spans; a taken name gets an underscore."""
    name = fresh(docs.columns, name)
    at, schema = docs.columns.index(text), T.StructType([*docs.schema.fields, T.StructField(name, SPANS)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text, BATCH_BYTES):
            found = [[{"start": s, "end": e, "kind": k, "score": p} for s, e, k, p in spans(t)] for t in batch.column(at).to_pylist()]
            columns = [batch.column(i).cast(arrow.field(i).type) for i in range(len(arrow) - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, arrow.field(len(arrow) - 1).type)], schema=arrow)

    return docs.mapInArrow(run, schema)


def redact(text: str | None, found: list[tuple[int, int, str, float]]) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    if text is None:
        return None
    out, at = [], 0
    for s, e, kind, _ in found:
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], f"[{kind}]"]
        at = e
    return "".join([*out, text[at:]])


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, all spans."""
    found = with_spans(docs.select(F.col("doc_id").cast("bigint"), "text"))
    counted = lambda k: F.size(F.filter("pii_spans", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    base = F.filter("pii_spans", lambda s: s["kind"].isin(BASE))
    listed = lambda a: F.concat_ws(",", F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    return found.select(
        "doc_id", *[counted(k) for k in BASE],
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii_spans")).alias("spans"),
        F.array_min(F.transform("pii_spans", lambda s: s["score"])).alias("lowest_score"),
    )
