"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Kinds, with what confirms a proposal:

* email, ip, card, phone: the base kinds. Addresses have octets up to 255, cards have 14 to 19 digits
  and pass Luhn, phones have 10 to 15 digits. A confirmed base span is always reported.
* iban: country code, check digits and up to 30 letters or digits that leave 1 modulo 97. A proposal may
  run into the words after it ("... 1332 BIC"), so its prefixes are tried too: the country's length first,
  then the longest. Every place that could begin one is tried.
* routing: nine digits passing the 3-7-1 checksum. Any ninth number or so passes it by chance, so
  it counts only if a context word stands nearby.
* ssn: three, two and four digits in valid ranges; context decides as well.

The score starts at the kind's prior, rises by CONTEXT_GAIN if one of the kind's context words stands
within CONTEXT_CHARS before the span or after it. Kinds that the base does not fix are kept from
THRESHOLD on and never overlap a base span.

Nulls and empty texts have no spans. Repeated rows give repeated results; other columns stay.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE = ("email", "ip", "card", "phone")
MORE = ("iban", "routing", "ssn")
KINDS = BASE + MORE
PRIOR = {"email": 0.95, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.7, "routing": 0.2, "ssn": 0.3}
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "routing": ("routing", "aba", "transit"),
    "ssn": ("ssn", "social security"),
}
CONTEXT_CHARS = 40
CONTEXT_GAIN = 0.3
THRESHOLD = 0.5

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
                   r"(?![A-Za-z0-9])", re.ASCII)
#: Letters and digits of each country's account numbers.
_IBAN_LENGTH = {country: n for n, countries in {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "PT", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL", 29: "BR EG PS QA UA",
    30: "JO KW MU", 31: "MT"}.items() for country in countries.split()}
_ROUTING = re.compile(r"(?<![0-9])[0-9]{9}(?![0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_CONTEXT = {kind: re.compile(r"(?<![a-z])(?:" + "|".join(words) + r")(?![a-z])")
            for kind, words in CONTEXT.items()}

SPAN = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])
_ARROW_SPANS = pa.list_(pa.struct([
    ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    compact = iban.replace(" ", "")
    if not 15 <= len(compact) <= 34:
        return False
    turned = compact[4:] + compact[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def aba(digits: str) -> bool:
    return sum(int(c) * w for c, w in zip(digits, (3, 7, 1) * 3)) % 10 == 0 and digits != "0" * 9


def ssn(text: str) -> bool:
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def _octets(text: str) -> bool:
    return all(int(part) <= 255 if len(part) < 4 else not part.strip("0") or
               (len(part.lstrip("0")) < 4 and int(part.lstrip("0")) <= 255)
               for part in text.split("."))


def _only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str):
    """Leftmost matches, from each @ to the left: the local part is a run of its characters."""
    done = 0
    for match in _AT.finditer(text):
        start = match.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < match.start():
            yield start, match.end()
            done = match.end()


def _ibans(text: str):
    """Spans that pass modulo 97; after a proposal that fails, the next may begin inside it."""
    at = 0
    while match := _IBAN.search(text, at):
        start, found = match.start(), match.group()
        length, ends = _IBAN_LENGTH.get(found[:2]), [len(found)]
        while (end := found.rfind(" ", 0, ends[-1])) > 0:
            ends.append(end)
        ends.sort(key=lambda e: e - found.count(" ", 0, e) != length)
        end = next((e for e in ends if mod97(found[:e])), None)
        if end:
            yield start, start + end
        at = start + (end or 1)


def _proposals(text: str):
    if "@" in text:
        for start, end in _emails(text):
            yield "email", start, end
    for match in _IP.finditer(text):
        if _octets(match.group()):
            yield "ip", *match.span()
    for match in _CARD.finditer(text):
        if match.end() - match.start() >= 14:
            digits = _only_digits(match.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield "card", *match.span()
    if "+" in text:
        for match in _PHONE.finditer(text):
            if 10 <= len(_only_digits(match.group())) <= 15:
                yield "phone", *match.span()
    for start, end in _ibans(text):
        yield "iban", start, end
    for match in _ROUTING.finditer(text):
        if aba(match.group()):
            yield "routing", *match.span()
    for match in _SSN.finditer(text):
        if ssn(match.group()):
            yield "ssn", *match.span()


def _score(text: str, kind: str, start: int, end: int) -> float:
    around = f"{text[max(0, start - CONTEXT_CHARS):start]} {text[end:end + CONTEXT_CHARS]}"
    gain = CONTEXT_GAIN if _CONTEXT[kind].search(around.lower()) else 0.0
    return round(min(1.0, PRIOR[kind] + gain), 6)


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """All spans of a text as (kind, start, end, score), by start and then by kind's order."""
    if not text:
        return []
    found = sorted(((s, KINDS.index(k), e) for k, s, e in _proposals(text)))
    starts, ends = [], []  # base spans, merged where they overlap
    for start, k, end in found:
        if k < len(BASE):
            if ends and start < ends[-1]:
                ends[-1] = max(ends[-1], end)
            else:
                starts.append(start)
                ends.append(end)
    spans = []
    for start, k, end in found:
        score = _score(text, KINDS[k], start, end)
        if k >= len(BASE):
            i = bisect_right(ends, start)
            if score < THRESHOLD or (i < len(starts) and starts[i] < end):
                continue
        spans.append((KINDS[k], start, end, score))
    return spans


def redact(text: str | None, spans) -> str | None:
    """Each span replaced by its kind in brackets; overlapping spans are replaced together."""
    if not text or not spans:
        return text
    out, at = [], 0
    for kind, start, end, _ in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    out.append(text[at:])
    return "".join(out)


def with_spans(df: DataFrame, text: str = "text", spans: str = "pii",
               clean: str | None = None) -> DataFrame:
    """`df` with its spans and, if `clean` names a column, the text without personal data.

    A column of that name is replaced. One pass without a shuffle.
    """
    names = [c for c in df.columns if c not in (spans, clean) or c == text]
    fields = [df.schema[c] for c in names if c != clean]
    schema = T.StructType([*fields, T.StructField(spans, T.ArrayType(SPAN))]
                          + ([T.StructField(clean, T.StringType())] if clean else []))

    def scan(batches):
        for batch in batches:
            texts = batch.column(text).to_pylist()
            found = [find(x) for x in texts]
            columns = [batch.column(f.name) for f in fields]
            columns.append(pa.array(
                [[dict(zip(("kind", "start", "end", "score"), s)) for s in f] for f in found],
                _ARROW_SPANS))
            if clean:
                columns.append(pa.array(map(redact, texts, found), pa.string()))
            yield pa.RecordBatch.from_arrays(
                columns, names=[f.name for f in fields] + [spans] + ([clean] if clean else []))

    return df.select(*names).mapInArrow(scan, schema)


def digest(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds and hashes of the spans."""
    found = with_spans(df.select(key, text), text, "pii").drop(text)
    names = F.array(*[F.lit(k) for k in BASE])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("pii", lambda s: F.array_contains(names, s["kind"]))
    def count(kind):
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in BASE]
    return found.select(
        key, *counts, F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("pii")).alias("spans"),
        F.round(F.aggregate("pii", F.lit(0.0), lambda a, s: F.greatest(a, s["score"])), 6)
        .alias("top_score"))
