"""Personal data: patterns propose spans, checksums confirm them, words nearby move the score.

Base kinds (email, ip, card, phone) are decided by pattern and check alone. Further kinds need more: an iban must
pass mod-97; a national id or a local phone number has no checksum and is kept only if words nearby lift its score
to the threshold. All scans are linear in the text, also for long runs of digits or letters.
Spans are code points, end exclusive. Null texts count as empty.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triplewright.llm.common import table, trimmed

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "national_id", "local_phone")
#: Score before context, and the least score of a span that is kept.
SCORE = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "national_id": 0.3, "local_phone": 0.3}
THRESHOLD = 0.5
#: Characters before and after a span in which context words count, what each distinct word adds, and the most that words add.
WINDOW, WORD_SCORE, MOST_WORDS = 40, 0.25, 2
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "adresse"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "national_id": ("ssn", "social", "security", "passport", "tax", "identity"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
}
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9])")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str):
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def _ips(text: str):
    for m in _CHAIN.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(map(_octet, four)):
                yield at, end
            at = end + 1


def _cards(text: str):
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            yield m.span()


def _ibans(text: str):
    """Of each proposed stretch the longest part up to a blank that mod-97 confirms; without one, later starts in it are tried."""
    at = 0
    while m := _IBAN.search(text, at):
        end = m.end()
        while end > m.start():
            compact = text[m.start() : end].replace(" ", "")
            if 15 <= len(compact) <= 34 and mod97(compact):
                yield m.start(), end
                break
            end = text.rfind(" ", m.start(), end)
        at = end if end > m.start() else m.start() + 4


def score(text: str, kind: str, start: int, end: int) -> float:
    """Base score of the kind plus what distinct context words nearby add."""
    near = {w.lower() for w in _WORD.findall(text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW])}
    return round(min(1.0, SCORE[kind] + WORD_SCORE * min(MOST_WORDS, len(near.intersection(CONTEXT[kind])))), 2)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the four base kinds, by start and then kind as listed."""
    out = [("email", *s) for s in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", *s) for s in _ips(text)] if "." in text else []
        out += [("card", *s) for s in _cards(text)]
        out += [("phone", *s) for s in _phones(text)] if "+" in text else []
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def all_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score): base spans, and others that touch none of them and reach the threshold."""
    base = base_spans(text)
    out = [(k, a, b, score(text, k, a, b)) for k, a, b in base]
    if not _DIGIT.search(text):
        return out
    found = []
    for kind, spans in (("iban", _ibans(text)), ("national_id", (m.span() for m in _NATIONAL.finditer(text))), ("local_phone", (m.span() for m in _LOCAL_PHONE.finditer(text)))):
        found += [(kind, a, b, s) for a, b in spans if (s := score(text, kind, a, b)) >= THRESHOLD]
    if found:
        taken = bytearray(len(text))
        for _, a, b in base:
            taken[a:b] = b"\1" * (b - a)
        for kind, a, b, s in found:
            if not any(taken[a:b]):
                taken[a:b] = b"\1" * (b - a)
                out.append((kind, a, b, s))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def redact(text: str, spans) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the union is replaced under the first's kind."""
    out, at = [], 0
    for kind, a, b, *_ in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))


def find(df: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """df with an array of (kind, start, end, score); a column of that name is replaced."""
    df = df.drop(into) if into in df.columns else df
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "score"), s)) for s in all_spans(t.as_py() or "")] for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, into])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(into, SPAN)]))


def redacted(df: DataFrame, text: str = "text") -> DataFrame:
    """df with its texts redacted; all columns keep their names and types, null texts stay null."""

    def run(batches):
        for batch in batches:
            new = pa.array([None if t is None else redact(t, all_spans(t)) for t in (x.as_py() for x in batch.column(text))], pa.string())
            yield batch.set_column(batch.schema.get_field_index(text), text, new)

    return df.mapInArrow(lambda batches: trimmed(run(batches)), df.schema)


def joined(spans) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


def digests(df: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of the base spans, all spans, their scores."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string"

    def run(batches):
        for batch in batches:
            rows = []
            for doc, t in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                found = all_spans(t.as_py() or "")
                base = [s for s in found if s[0] in BASE]
                kinds = [s[0] for s in base]
                rows.append((doc, *(kinds.count(k) for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(found), ",".join(f"{s[3]:.2f}" for s in found)))
            columns = list(zip(*rows)) or [()] * 8
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:5]), *(pa.array(c, pa.string()) for c in columns[5:])], [c.split()[0] for c in schema.split(", ")])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
