"""Personal data: regular expressions propose spans, checksums confirm them, words nearby move the score.

Kinds, in the order of results: email, ip, card, phone (the base kinds), then
iban and ssn.  Base spans are leftmost and non-overlapping a kind, checked by
their validators (octets, Luhn, digit counts), and always stay, whatever their
score; iban (mod 97) and ssn stay only at a score of `keep` or more and where
they overlap no base span.

All scans take linear time: an email is found from its @ outwards, never by
retrying a run of letters from each of its places; an ip is cut from a whole run of dotted numbers, whose groups of four
are its leftmost matches; iban and ssn spans are held against base spans in one merge by start.

Defined results: null text is empty; offsets are code points, end exclusive; rows are independent, so repeated
ids stay repeated.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructType

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
SPANS = ArrayType(StructType().add("kind", StringType()).add("start", LongType()).add("end", LongType()).add("score", DoubleType()))
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile(r"[0-9]")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.85, "phone": 0.7, "iban": 0.8, "ssn": 0.45}
NEAR = {
    "email": ("mail", "email", "contact", "correo"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "credit", "payment", "tarjeta", "carte", "karte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
}
AGAINST = {"ip": ("version", "release", "v"), "card": ("order", "isbn", "serial"), "phone": ("order", "isbn", "serial"), "ssn": ("part", "serial", "isbn")}
NEAR_CHARS = 40
WORDS = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = ord(d) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(DIGIT.findall(s))


def _emails(t: str) -> Iterator[tuple[int, int]]:
    end, at = 0, t.find("@")
    while at >= 0:
        lo = at
        while lo > end and t[lo - 1] in LOCAL:
            lo -= 1
        if lo < at and (m := DOMAIN.match(t, at)):
            end = m.end()
            yield lo, end
        at = t.find("@", max(at + 1, end))


def _ips(t: str) -> Iterator[tuple[int, int]]:
    for m in DOTTED.finditer(t):
        # a run that ends in fewer than four numbers has no further match within it
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            end = at + sum(map(len, parts[i : i + 4])) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in parts[i : i + 4]):
                yield at, end
            at = end + 1


def _free(more: list[tuple[str, int, int]], base: list[tuple[int, int]]) -> Iterator[tuple[str, int, int]]:
    """Those of more that overlap none of base; both are sorted by start within a kind."""
    reach, starts = [], []
    for a, b in sorted(base):
        starts.append(a)
        reach.append(max(b, reach[-1] if reach else 0))
    for kind, a, b in more:
        before = bisect_left(starts, b)  # base spans that start before b
        if not before or reach[before - 1] <= a:
            yield kind, a, b


def _score(t: str, kind: str, a: int, b: int) -> float:
    words = set(WORDS.findall(t[max(0, a - NEAR_CHARS) : a].lower() + " " + t[b : b + NEAR_CHARS].lower()))
    s = PRIOR[kind] + 0.25 * bool(words.intersection(NEAR[kind])) - 0.3 * bool(words.intersection(AGAINST.get(kind, ())))
    return round(min(1.0, max(0.0, s)), 4)


def find(text: str | None, keep: float = 0.5) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind as in KINDS, then start."""
    t, out = text or "", []
    if "@" in t:
        out += [("email", a, b) for a, b in _emails(t)]
    if DIGIT.search(t):
        out += [("ip", a, b) for a, b in _ips(t)]
        out += [("card", m.start(), m.end()) for m in CARD.finditer(t) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in t:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(t) if 9 <= len(_digits(m[0])) <= 15]
        more = [("iban", m.start(), m.end()) for m in IBAN.finditer(t) if mod97(m[0])] + [("ssn", m.start(), m.end()) for m in SSN.finditer(t)]
        out += [(k, a, b) for k, a, b in _free(more, [s[1:] for s in out]) if _score(t, k, a, b) >= keep]
    return [(k, a, b, _score(t, k, a, b)) for k, a, b in out]


def redact(text: str | None, spans: list[tuple[str, int, int, float]]) -> str | None:
    """Each run of overlapping spans is replaced by the kind of its first in brackets."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def annotate(docs: DataFrame, text: str = "text", keep: float = 0.5, spans_as: str = "spans", redacted_as: str | None = None) -> DataFrame:
    """docs with the found spans (and, if asked for, the text with them replaced) added; other columns pass through."""
    cols = [c for c in docs.columns if c not in (spans_as, redacted_as)]
    schema = docs.select(*cols).schema.add(spans_as, SPANS)
    if redacted_as:
        schema = schema.add(redacted_as, "string")
    at = cols.index(text)
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x.as_py() for x in b.column(at)]
            found = [find(t, keep) for t in texts]
            more = [pa.array([[dict(zip(("kind", "start", "end", "score"), s)) for s in f] for f in found], arrow)]
            names = [*cols, spans_as]
            if redacted_as:
                more.append(pa.array([redact(t, f) for t, f in zip(texts, found)], pa.string()))
                names.append(redacted_as)
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=names)

    return docs.select(*cols).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    from lattix.session import read_table

    out = annotate(read_table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text")))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(k) for k in BASE]
    return out.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))
