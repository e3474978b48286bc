import random

import numpy as np
import plain
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ticketloom.llm import catalog, token_codes
from ticketloom.session import scratch_path

PATH = catalog.tokenizer_path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def expected(docs):
    out, start = [], 0
    for doc in sorted(docs, key=lambda d: d["doc_id"]):
        ids = TOKENIZER.encode(doc["text"] or "", add_special_tokens=False).ids + [1]
        out.append((doc["doc_id"], start, len(ids), plain.crc(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_given_table(spark):
    got = catalog.op2_token_codes(spark, plain.SF01).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == expected(plain.rows("documents", plain.SF01))


def test_word_encoder_equals_whole_texts():
    rng = random.Random(2)
    pieces = ["the", "Don't", " ", "  ", "\n", "\t", " ", "́", "é", "ΑΣ", "é", "!!", "3rd",
              "<|endoftext|>", "<|startoftext|>", "中文", "\x1c", " ", "İ", "x'll", "🙂", "\r\n", "_", "\x00"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(3000)]
    coded = token_codes.WordEncoder(PATH)(pa.array(texts))
    for text, ids in zip(texts, coded):
        want = TOKENIZER.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(text)


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_every_position_is_addressable(n):
    rng = np.random.default_rng(n)
    ids = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
    found = token_codes.Segment(token_codes.pack(3, 4, [5, None], np.array([0, n // 2, n]), ids))
    assert (found.part, found.segment, found.keys) == (3, 4, [5, None])
    assert found.ids().tolist() == ids.tolist()
    for i in list(range(min(n, 40))) + list(range(max(0, n - 40), n)):
        assert found[i] == ids[i]
    a, b = n // 3, n - n // 4
    assert found.ids(a, b).tolist() == ids[a:b].tolist()


def test_rows_nulls_and_small_segments(spark, monkeypatch):
    docs = [(2, "b b"), (1, None), (None, "x"), (2, "a"), (2, "a"), (3, ""), (4, "word " * 3000)]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs],
                               "doc_id long, text string, key int, mark int")
    folder = scratch_path(spark, "codes")
    manifest = token_codes.write(df, folder, lambda: token_codes.encoder(PATH))
    got = token_codes.read(spark, folder).collect()
    assert manifest.count() >= 1 and len(got) == len(docs)
    spans = sorted((r["start"], r["start"] + r["n_tokens"], r["key"]) for r in got)
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[0][0] == 0
    assert [k for *_, k in spans] == [None, 1, 2, 2, 2, 3, 4]
    assert sorted((r["key"] or 0, len(r["ids"]) - 1) for r in got) == sorted(
        (k or 0, len(TOKENIZER.encode(t or "", add_special_tokens=False).ids)) for k, t in docs)
    assert token_codes.digest(df.limit(0), PATH).collect() == []
