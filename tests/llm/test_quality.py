import math
import re
import zlib

import numpy as np
import plain

from ticketloom.llm import arrays, catalog, quality


def test_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in catalog.op5_subword_quality(spark, plain.SF01).collect()}
    docs = plain.rows("documents", plain.SF01)
    assert len(got) == len(docs)
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    held = [(got[m["doc_id"]], m["quality"]) for m in plain.rows("labels", plain.SF01)
            if got[m["doc_id"]]["held_out"]]
    right = sum(r["predicted"] == y for r, y in held)
    assert len(held) > 50 and right / len(held) > 0.95
    pairs = [(a["score"], b["score"]) for a, x in held for b, y in held if x > y]
    assert sum(a > b for a, b in pairs) / len(pairs) > 0.97


def test_rows_and_missing_labels(spark):
    docs = spark.createDataFrame(
        [(i, t, 0.5) for i, t in [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "c")]],
        "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.digest(docs, none).collect()
    assert [r["score"] for r in out] == [0.5] * 5
    one = spark.createDataFrame([(3, 1), (None, 0), (2, None)], "doc_id long, quality int")
    assert all(r["predicted"] == 1 for r in quality.digest(docs, one).collect())
    assert quality.digest(docs.limit(0), one).collect() == []


def test_bound_on_the_sample_is_kept(spark):
    rows = [(i, ("good words here " if i % 2 else "b@@d !! ") * 5) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    model = quality.fit(docs, labels, per_class=20)
    got = quality.with_score(docs, model).collect()
    assert all((r["score"] > 0.5) == (r["doc_id"] % 2 == 1) for r in got)
    again = quality.Model.from_bytes(model.to_bytes())
    assert abs(again.offset - model.offset) < 1e-6


def test_a_column_named_text_is_not_scored(spark):
    rows = [(i, ("good words here " if i % 2 else "b@@d !! ") * 5) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    want = {r["doc_id"]: r["score"] for r in quality.with_score(docs, model).collect()}
    more = docs.selectExpr("'b@@d !! ' as _text", "doc_id", "text", "0 as c0")
    out = quality.with_score(more, model)
    assert out.columns == [*more.columns, "score"]
    assert {r["doc_id"]: r["score"] for r in out.collect()} == want


def plain_score(text, model):
    """The score by its definition, one text and one feature at a time."""
    gaps = b" \t\n\v\f\r\0"
    data = (text or "").encode()
    found = []
    words = [w for w in re.split(rb"[ \t\n\x0b\x0c\r\0]+", data) if w]
    for i, word in enumerate(words):
        one = np.frombuffer(word, dtype=np.uint8)
        found.append(int(arrays.word_hashes(one, np.array([0]), np.array([len(one)]))[0]) % quality.BUCKETS)
        if i and words[i - 1] == word:
            found.append(quality.BUCKETS)
    shown = b"\n" + bytes(10 if b in gaps else b for b in data) + b"\n"
    for k in quality.GRAMS:
        for i in range(len(shown) - k + 1):
            gram = shown[i:i + k]
            if 10 in gram[1:-1] or gram[0] == gram[-1] == 10:
                continue
            code = int.from_bytes(bytes([k]) + gram, "big") * arrays.STEP % 2 ** 64 >> 47
            found.append(code % quality.BUCKETS)
    gains = model.gains()
    odds = sum(gains[f] for f in found) / max(1, len(found)) + model.offset
    return 1 / (1 + math.exp(-min(40, max(-40, odds))))


def test_scores_equal_the_definition_whatever_stands_beside_a_text(spark):
    texts = [r["text"] for r in plain.rows("documents")[:60]]
    texts += [None, "", "a", "aa aa aa", " x", "x ", "\n\t", "żółć ", "a\0b", "word" * 400, "a", None, "z"]
    rng = np.random.default_rng(5)
    model = quality.Model(rng.normal(size=(quality.BUCKETS + 1, quality.DIM)).astype(np.float32),
                          rng.normal(size=(quality.DIM, 2)).astype(np.float32), np.array([0.0, 0.3]), 0.5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for parts in (1, 7):
        got = {r["doc_id"]: r["score"] for r in quality.with_score(docs.repartition(parts), model).collect()}
        for i, text in enumerate(texts):
            assert abs(got[i] - plain_score(text, model)) < 1e-8, (parts, i, text)
