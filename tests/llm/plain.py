"""Slow, plain statements of the contracts, for comparison on small tables."""

import hashlib
import re
import zlib

import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


def rows(name, sf=SF):
    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(data):
    return zlib.crc32(data) & 0xFFFFFFFF


_UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_UPPER))


def contamination(docs, items, window=10):
    by_length = {}
    for item in items:
        if item["item_id"] is None:
            continue
        w = words(item["text"])
        n = min(len(w), window)
        for i in range(len(w) - n + 1 if n else 0):
            by_length.setdefault(n, {}).setdefault(tuple(w[i:i + n]), set()).add(str(item["item_id"]))
    out = []
    for doc in docs:
        w, hit, found = words(doc["text"]), set(), set()
        for n, known in by_length.items():
            for i in range(len(w) - n + 1):
                ids = known.get(tuple(w[i:i + n]))
                if ids:
                    hit.update(range(i, i + n))
                    found |= ids
        out.append((doc["doc_id"], len(w), len(hit), len(found), sha(",".join(sorted(found))),
                    bool(hit)))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        total += sum(map(int, str(int(c) * 2))) if i % 2 else int(c)
    return total % 10 == 0


BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
     lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+",
     lambda m: 14 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
)


def base_spans(text):
    found = []
    for order, (kind, pattern, ok) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            if ok(m.group()):
                found.append((m.start(), order, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]
