import random

import numpy as np
import plain
import pytest

from ticketloom.llm import catalog, pieces

PATH = catalog.tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(PATH)


def all_segmentations(vocabulary, text):
    """Every segmentation of a short text with its score."""
    if not text:
        return [(0, [])]
    out = []
    for k in range(1, min(len(text), vocabulary.longest) + 1):
        score = vocabulary.edge(text[:k])
        if score is not None:
            ids = vocabulary.ids(text[:k])
            out += [(score + s, ids + rest) for s, rest in all_segmentations(vocabulary, text[k:])]
    return out


@pytest.mark.parametrize("n", [1, 3, 7])
def test_nbest_equals_brute_force(vocabulary, n):
    rng = random.Random(n)
    texts = ["", "a", " ", "the", "don't 中", "é▁ x", "\n\n a", "🙂a", "  two", "tion the"]
    texts += ["".join(rng.choice("aehnrst \n.é☃") for _ in range(rng.randrange(1, 11))) for _ in range(60)]
    for text, found in zip(texts, pieces.Encoder(vocabulary, n)(texts)):
        shown = pieces.MARK + text.replace("▁", pieces.LITERAL_MARK).replace(" ", pieces.MARK) if text else ""
        every = all_segmentations(vocabulary, shown)
        want = sorted((s for s, _ in every), reverse=True)[:n]
        assert [s for s, _ in found] == want, text
        known = {(s, tuple(ids)) for s, ids in every}
        ids = [tuple(np.frombuffer(x, "<u4").tolist()) for _, x in found]
        assert len(set(ids)) == len(ids)
        assert all((s, i) in known for (s, _), i in zip(found, ids)), text
        assert all(vocabulary.decode(i) == text for i in ids)


def test_one_and_many_agree(vocabulary):
    rng = random.Random(9)
    chunks = sorted({"▁" + "".join(rng.choice("theandirs") for _ in range(11)) for _ in range(200)})
    scores, paths = pieces.search_many(vocabulary, chunks, 4)
    for chunk, row, ids in zip(chunks, scores.tolist(), paths):
        single = pieces.search_one(vocabulary, chunk, 4)
        assert [s for s, _ in single] == row[:len(single)] and len(ids) == len(single)


def test_given_table(spark):
    docs = {d["doc_id"]: d["text"] for d in plain.rows("documents")}
    got = catalog.op6_nbest_pieces(spark, plain.SF).collect()
    assert len(got) == len(docs) and all(r["round_trip"] for r in got)
    for r in got:
        assert r["piece_score"] == r["nbest_scores"][0] == max(r["nbest_scores"])
        assert (r["n_pieces"] == 0) == (not docs[r["doc_id"]])
        assert len(set(r["nbest_crc32"])) == len(r["nbest_crc32"])


def test_rows(spark):
    df = spark.createDataFrame([(1, None, 4), (1, "", 4), (2, "x" * 3000 + " y" * 3000, 5)],
                               "doc_id long, text string, n_pieces int")
    out = pieces.with_pieces(df, PATH).collect()
    assert [r["n_pieces"] for r in out[:2]] == [0, 0] and out[2]["round_trip"]
    assert len(out[2]["piece_ids"]) == out[2]["n_pieces"]
    assert pieces.with_pieces(df.limit(0), PATH).collect() == []


def test_chunks_met_again_are_not_searched_again(vocabulary, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_CHUNKS", 60)
    rng = random.Random(5)
    common = "the cat sat on a mat and then it ran off"
    texts = [common + "".join(f" {rng.randrange(10**9)}" for _ in range(20)) for _ in range(12)] + [
        " ".join(str(rng.randrange(10**9)) for _ in range(100)), common]
    coder, searched = pieces.Encoder(vocabulary, 3), []
    learn = coder._learn
    monkeypatch.setattr(coder, "_learn", lambda new: searched.extend(new) or learn(new))
    for text in texts:
        assert coder([text]) == pieces.Encoder(vocabulary, 3)([text])
        assert len(coder.index) <= 60 or text is texts[12]
    assert searched.count("▁cat") == 2  # at first, and after the text that fills the memory alone


def test_one_and_many_agree_in_order_of_paths(vocabulary):
    rng = random.Random(11)
    chunks = sorted({"▁" + "".join(rng.choice("theandirs") for _ in range(9)) for _ in range(200)})
    for n in (1, 2, 5):
        scores, paths = pieces.search_many(vocabulary, chunks, n)
        for chunk, row, ids in zip(chunks, scores.tolist(), paths):
            single = pieces.search_one(vocabulary, chunk, n)
            assert len({bytes(i) for i in ids}) == len(ids) == len(single)
            for s, i in zip(row, ids):
                if row.count(s) == 1 and s != row[len(single) - 1]:
                    assert i == vocabulary.coded(next(cut for t, cut in single if t == s))
