"""Different words get different hashes, also where patterns of bytes would cancel out."""

import random

import numpy as np
import plain
import pyarrow as pa
from tokenizers import Tokenizer

from ticketloom.llm import arrays, catalog, licences, lm_scoring, near_dup, token_codes


def doubling(n, a="a", b="b"):
    """The alternating doubling sequence of two letters: a polynomial modulo 2**64 can't tell it, at 1,024
    letters, from its complement."""
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


PAIR = doubling(1024), doubling(1024, "b", "a")


def hashes(words):
    data = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
    return arrays.WordTable(data, np.array([0, len(data)]), arrays.TOKENS).hashes


def test_no_collisions_among_patterned_words():
    words = {doubling(n, *p) for n in (64, 512, 1024, 2048, 4096) for p in ("ab", "ba", "xy", "yx")}
    words |= {"a" * n for n in range(1, 200)} | {"ab" * n for n in range(1, 200)}
    words |= {"x" * n + "y" * (40 - n) for n in range(41)} | {"x" * n + "yz" + "x" * (38 - n) for n in range(39)}
    rng = random.Random(1)
    words |= {"".join(rng.choices("ab", k=rng.randrange(1, 40))) for _ in range(20_000)}
    words = sorted(words)
    assert len(set(hashes(words).tolist())) == len(words)


def test_a_hash_depends_on_the_word_alone(monkeypatch):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcé0", k=rng.randrange(1, 60))) for _ in range(500)]
    want = {w: int(h) for w, h in zip(words, hashes(words))}
    monkeypatch.setattr(arrays, "CHUNK_BYTES", 70)
    again = words[::-1]
    assert [int(h) for h in hashes(again)] == [want[w] for w in again]


def test_token_ids_of_the_pair():
    path = catalog.tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    coder = token_codes.WordEncoder(path)
    texts = [PAIR[0], PAIR[1], f"{PAIR[1]} {PAIR[0]}", doubling(2048), doubling(2048, "b", "a")]
    for text, found in zip(texts, coder(pa.array(texts))):
        assert np.frombuffer(found, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_texts_that_differ_in_the_pair_are_no_copies(spark):
    docs = [(1, PAIR[0]), (2, PAIR[1]), (3, f"one two three four {PAIR[0]}"), (4, f"one two three four {PAIR[1]}")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {tuple(r) for r in near_dup.digest(df).collect()} == {(i, i, 1) for i in range(1, 5)}


def test_scores_tell_the_pair_apart(spark):
    docs = [(1, f"{PAIR[0]} a"), (2, f"{PAIR[0]} a"), (3, f"{PAIR[1]} b")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    found = {r["doc_id"]: r["ce_background"] for r in lm_scoring.digest(df, labels).collect()}
    assert found[1] == found[2] != found[3]


def test_bigrams_of_the_pair_differ():
    grams = [licences.arrays.WordTable(np.frombuffer(f"x {w}".encode(), np.uint8),
                                       np.array([0, 1026]), arrays.WORDS).grams(2)[0] for w in PAIR]
    assert grams[0].tolist() != grams[1].tolist() and plain.words(PAIR[0]) == [PAIR[0]]
