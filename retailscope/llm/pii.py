"""Personal data: patterns propose spans, checksums confirm them, words nearby raise or lower their score.

Kinds and what confirms them: `email`; `ip` (four parts of at most 255); `card` (14 to 19 digits, Luhn); `phone` (10 to
15 digits); `iban` (length 15 to 34, remainder 1 modulo 97); `key` (access key ids); `secret` (a value given to a
password, token or key); `ssn` (kept only where the words around speak for it).
Every pattern is scanned in time linear in the text: a run of characters that fails is not tried again from its middle.

Missing texts count as empty and have no spans. Rows keep their order and multiplicity. An empty table gives an empty
result. Columns other than the two named ones are not read by `find`; `mask` keeps all columns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailscope.llm.common import parts_of, release, texts_of

KINDS = ("email", "ip", "card", "phone", "iban", "key", "secret", "ssn")
BASE = KINDS[:4]
#: Score of a confirmed span before the words around it count.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "key": 0.9, "secret": 0.8, "ssn": 0.4}
#: Words that speak for a kind within `REACH` characters of a span, and words that speak against it.
FOR = {
    "email": r"mail|contact|write to",
    "ip": r"\bip\b|address|host|server",
    "card": r"card|visa|credit|pay",
    "phone": r"phone|tel\b|call|mobile|fax",
    "iban": r"iban|bank|account|konto|compte|cuenta",
    "key": r"aws|key|access|secret",
    "secret": r"pass|token|secret|key|login",
    "ssn": r"ssn|social security",
}
AGAINST = {"ip": r"version|release|\bv$", "phone": r"part no|serial", "card": r"order no|serial", "ssn": r"serial|part no", "secret": r"example|sample"}
REACH = 40
LEAST = 0.5

_FOR = {k: re.compile(v, re.IGNORECASE) for k, v in FOR.items()}
_AGAINST = {k: re.compile(v, re.IGNORECASE) for k, v in AGAINST.items()}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_KEY = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])")
_SECRET = re.compile(r"\b(?:token|secret|passw(?:or)?d|api[_-]?key)\b[\"']?[ \t]{0,4}[=:][ \t]{0,4}[\"']?([A-Za-z0-9_+/=.~-]{8,})", re.IGNORECASE)
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for at, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if at & 1:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Remainder 1 of the number that the rearranged account reads as (A is 10, Z is 35)."""
    plain = iban.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            floor = domain.end()
            yield start, floor
        at = text.find("@", max(at + 1, floor))


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        end = m.end()
        while end > m.start():  # words in capitals may follow the account
            if mod97(text[m.start() : end]):
                yield m.start(), end
                break
            end = text.rfind(" ", m.start(), end)


def score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's prior, moved a quarter of the way or more by the words around."""
    around = (text[max(0, start - REACH) : start], text[end : end + REACH])
    value = PRIOR[kind]
    if any(_FOR[kind].search(x) for x in around):
        value += (1 - value) / 2
    if kind in _AGAINST and any(_AGAINST[kind].search(x) for x in around):
        value /= 2
    return round(value, 4)


def spans_of(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start and then kind; base kinds stay whatever their score is."""
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += [("email", *s) for s in emails(text)]
    if _DIGIT.search(text):
        found += [("ip", *s) for s in ips(text)]
        found += [("card", *s) for s in cards(text)]
        if "+" in text:
            found += [("phone", *s) for s in phones(text)]
        found += [("iban", *s) for s in ibans(text)]
        if "AKIA" in text or "ASIA" in text:
            found += [("key", *m.span()) for m in _KEY.finditer(text)]
        found += [("ssn", *m.span()) for m in _SSN.finditer(text)]
    if "=" in text or ":" in text:
        found += [("secret", *m.span(1)) for m in _SECRET.finditer(text)]
    if not found:
        return []
    scored = [(k, a, b, score(text, k, a, b)) for k, a, b in found]
    return sorted((s for s in scored if s[0] in BASE or s[3] >= LEAST), key=lambda s: (s[1], KINDS.index(s[0])))


def written(spans: list[tuple]) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


SPANS = "array<struct<kind:string,start:long,end:long,score:double>>"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its spans, with scores."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            for part in parts_of(batch):
                found = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in spans_of(t)] for t in texts_of(part)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(job, f"doc_id long, spans {SPANS}")


def report(found: DataFrame) -> DataFrame:
    """Counts of the base kinds and the spans as text, from `find`'s rows."""
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    join = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *(of(k) for k in BASE), F.sha2(join(base).cast("binary"), 256).alias("base_sha256"), join(F.col("spans")).alias("spans"))


def masked(text: str) -> str:
    """Each stretch covered by spans becomes the name of its first kind."""
    out, at = [], 0
    for kind, start, end, _ in spans_of(text):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join(out) + text[at:] if out else text


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of `docs`, with the personal data in its text replaced; a missing text stays missing."""

    @F.pandas_udf("string")
    def hide(texts):
        release()
        return texts.map(lambda t: t if t is None else masked(t))

    return docs.withColumn(text_col, hide(F.col(text_col)))
