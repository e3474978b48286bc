import random

import plain
import pytest

from ticketloom.llm import arrays, catalog, winnow

COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def collected(df):
    return sorted(map(repr, (tuple(r[c] for c in COLUMNS) for r in df.collect())))


def frames(spark, docs, items):
    return (spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(items, "item_id long, text string"))


@pytest.mark.parametrize("sf", [plain.SF, plain.SF01])
def test_given_tables(spark, sf):
    want = plain.contamination(plain.rows("documents", sf), plain.rows("benchmark", sf))
    assert sum(r[-1] for r in want)
    assert collected(catalog.op8_winnow_contamination(spark, sf)) == sorted(map(repr, want))


def test_awkward_rows(spark):
    rng = random.Random(5)
    vocabulary = ["a", "b", "c", "Ünd", "d1", "E"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = text(30)
    docs = [(1, None), (2, ""), (3, "!?"), (4, shared), (4, shared), (None, shared.upper()),
            (5, text(9)), (6, text(4000)), (7, "a,b;C-" + shared + "\n x"), (8, "solo")]
    docs += [(100 + i, text(rng.randrange(60))) for i in range(80)]
    items = [(1, shared), (1, text(12)), (2, "solo"), (3, text(5)), (4, None), (5, ""),
             (None, "a b"), (6, text(10)), (7, shared), (8, "..")]
    d, i = frames(spark, docs, items)
    want = plain.contamination([dict(doc_id=a, text=b) for a, b in docs],
                               [dict(item_id=a, text=b) for a, b in items])
    assert collected(winnow.digest(d, i)) == sorted(map(repr, want))


def test_empty_tables_and_clashing_columns(spark):
    d, i = frames(spark, [], [(1, "a b")])
    assert winnow.digest(d, i).collect() == []
    d, i = frames(spark, [(1, "a b")], [])
    assert collected(winnow.digest(d, i)) == [repr((1, 2, 0, 0, plain.sha(""), False))]
    wide = spark.createDataFrame([(1, "x a b", 9, "w", 7)],
                                 "doc_id long, text string, n_hit int, win string, _row int")
    _, i = frames(spark, [], [(1, "a b")])
    (row,) = winnow.contamination(wide, i).collect()
    assert (row["n_hit"], row["win"], row["_row"], row["text"]) == (2, "w", 7, "x a b")
    assert [tuple(s) for s in row["hit_spans"]] == [(1, 2)]


def test_every_shared_window_has_a_common_fingerprint():
    import numpy as np

    rng = random.Random(1)
    shared = [rng.choice("abcdefgh") for _ in range(10)]
    texts = [" ".join([rng.choice("xyzab") for _ in range(rng.randrange(20))] + shared
                      + [rng.choice("xyzab") for _ in range(rng.randrange(20))]) for _ in range(50)]
    data = "".join(texts).encode()
    offsets = np.cumsum([0] + [len(t) for t in texts])
    table = arrays.WordTable(np.frombuffer(data, dtype=np.uint8), offsets, arrays.WORDS)
    hashes, _, row = winnow.fingerprints(table, 10, 5)
    inside = set(hashes[row == 0].tolist())
    for r in range(1, 50):
        inside &= set(hashes[row == r].tolist())
    assert inside
