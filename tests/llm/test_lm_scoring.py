import math
import re
from collections import Counter

import numpy as np
import plain

from ticketloom.llm import catalog, lm_scoring
from ticketloom.llm.packing import pack, unpack


def brute(docs, target_ids):
    split = [[t for t in re.split(r"[ \t\n\v\f\r\0]+", d["text"] or "") if t] for d in docs]
    least = lm_scoring.LEAST_COUNT
    every = Counter(t for s in split for t in s)
    known = {t for t, n in every.items() if n >= least}
    split = [[t if t in known else None for t in s] for s in split]
    pairs = [list(zip(["<s>"] + s, s)) for s in split]
    kept = {p for p, n in Counter(p for s in pairs for p in s).items() if n >= least}
    losses = []
    for chosen in ([True] * len(docs), [d["doc_id"] in target_ids for d in docs]):
        word = Counter(t for s, c in zip(split, chosen) if c for t in s)
        pair = Counter(p for s, c in zip(pairs, chosen) if c for p in s)
        head = Counter(h for s, c in zip(pairs, chosen) if c for h, _ in s)
        held = Counter()
        for (h, w), n in pair.items():
            if (h, w) in kept:
                held[h] += n
        n, size = sum(word.values()), len(known) + 1

        def chance(h, w):
            c = max(head[h], 1)
            own = pair[h, w] if (h, w) in kept else 0
            return lm_scoring.MIX * own / c + (1 - lm_scoring.MIX * held[h] / c) * (word[w] + 1) / (n + size)

        losses.append([-sum(math.log(chance(*p)) for p in s) / max(len(s), 1) for s in pairs])
    return {d["doc_id"]: (len(s), t, b) for d, s, b, t in zip(docs, split, *losses)}


def check(got, want, tol=1e-6):
    assert len(got) == len(want)
    for r in got:
        n, target, background = want[r["doc_id"]]
        assert r["n_tokens"] == n
        assert math.isclose(r["ce_target"], target, abs_tol=tol)
        assert math.isclose(r["ce_background"], background, abs_tol=tol)
        assert math.isclose(r["ce_difference"], target - background, abs_tol=tol)


def test_given_table(spark):
    docs = plain.rows("documents")
    good = {r["doc_id"] for r in plain.rows("labels") if r["quality"] == 1}
    check(catalog.op1_cross_entropy_difference(spark, plain.SF).collect(), brute(docs, good))


def test_rare_words_nulls_and_no_target(spark):
    docs = [(1, "a b a b c"), (2, None), (3, ""), (4, "a b \n z"), (5, "c c c a"), (6, " " * 9)]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, n int, gram int")
    plainly = [dict(doc_id=i, text=t) for i, t in docs]
    labels = spark.createDataFrame([(1, 1), (1, 1), (5, 0), (None, 1)], "doc_id long, quality int")
    check(lm_scoring.digest(df, labels).collect(), brute(plainly, {1}))
    check(lm_scoring.digest(df, labels.limit(0)).collect(), brute(plainly, set()))
    assert lm_scoring.digest(df.limit(0), labels).collect() == []


def test_spilled_counts_are_exact(spark, monkeypatch):
    docs = plain.rows("documents")[:60]
    df = spark.createDataFrame([(d["doc_id"], d["text"]) for d in docs], "doc_id long, text string")
    keys = df.filter("doc_id % 3 = 0").select("doc_id")
    want = lm_scoring.with_losses(df, keys).collect()
    monkeypatch.setattr(lm_scoring, "BROADCAST_KEYS", 3)
    assert sorted(map(tuple, lm_scoring.with_losses(df, keys).collect())) == sorted(map(tuple, want))


def test_least_count_does_not_rise_with_the_corpus(spark):
    # 2.1 million tokens: a share of one in a million would ask for three of a word or bigram
    docs = [(1, "rare pair here"), (2, "rare pair there"), (3, "a b " * 1_050_000), (4, "b a rare")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    plainly = [dict(doc_id=i, text=t) for i, t in docs]
    check(lm_scoring.digest(df, labels).collect(), brute(plainly, {1}))


def test_groups_do_not_change_scores(spark, monkeypatch):
    docs = plain.rows("documents")[:80]
    df = spark.createDataFrame([(d["doc_id"], d["text"], "x") for d in docs],
                               "doc_id long, text string, _text string").repartition(3)
    keys = df.filter("doc_id % 3 = 0").select("doc_id")
    plainly = brute(docs, {d["doc_id"] for d in docs if d["doc_id"] % 3 == 0})
    monkeypatch.setattr(lm_scoring, "GROUP_BYTES", 3_000)
    found = lm_scoring.with_losses(df, keys)
    assert found.columns[:3] == df.columns and {r["_text"] for r in found.collect()} == {"x"}
    check(found.collect(), plainly, 2e-9)


def test_hot_histories_and_many_parts(spark, monkeypatch):
    # a third of the tokens is one word; hot histories meet their followers in several parts
    docs = [dict(d, text=re.sub(r" ", " the ", d["text"] or "", count=400)) for d in plain.rows("documents")[:70]]
    docs += [dict(doc_id=-1, text=None), dict(doc_id=-2, text="the " * 500)]
    df = spark.createDataFrame([(d["doc_id"], d["text"]) for d in docs], "doc_id long, text string").repartition(3)
    plainly = brute(docs, {d["doc_id"] for d in docs if d["doc_id"] % 3 == 0})
    for name, value in (("GROUP_BYTES", 9_000), ("PART_KEYS", 700), ("HOT_COUNT", 20), ("ROW_TOKENS", 100)):
        monkeypatch.setattr(lm_scoring, name, value)
    check(lm_scoring.with_losses(df, df.filter("doc_id % 3 = 0").select("doc_id")).collect(), plainly, 2e-9)


def test_packed_integers_come_back():
    for values in ([], [0], [0, 0], [1, 255, 256, 1 << 40], [-1, 5], [1 << 62, -(1 << 63)]):
        assert unpack(pack(np.array(values, dtype=np.int64))).tolist() == values
    hashes = np.array([3, (1 << 64) - 1], dtype=np.uint64)
    assert unpack(pack(hashes)).view(np.uint64).tolist() == hashes.tolist()
