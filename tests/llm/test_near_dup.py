import random
from collections import Counter

import numpy as np
import plain
import pytest

from ticketloom.llm import arrays, catalog, components, near_dup


def bag(text):
    w = plain.words(text)
    k = min(len(w), 5)
    return Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if k else Counter()


def probability_jaccard(a, b):
    total, known = 0.0, {}
    for d in a.keys() & b.keys():
        pair = (a[d], b[d])
        if pair not in known:
            known[pair] = 1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in a.keys() | b.keys())
        total += known[pair]
    return total


def classes(docs, threshold=0.8):
    """Classes of row numbers by brute force over all pairs."""
    bags, parent = [bag(t) for t in docs], list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if docs[i] is None or docs[j] is None:
                continue
            same = docs[i] == docs[j]
            if not same and bags[i].keys() & bags[j].keys():
                same = probability_jaccard(bags[i], bags[j]) >= threshold - 1e-12
            if same:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(docs))]


def grouped(pairs):
    out = {}
    for member, label in pairs:
        out.setdefault(label, set()).add(member)
    return sorted(map(sorted, out.values()))


def test_given_table(spark):
    docs = sorted(plain.rows("documents", plain.SF01), key=lambda d: d["doc_id"])
    want = grouped(zip([d["doc_id"] for d in docs], classes([d["text"] for d in docs])))
    got = catalog.op4_probminhash_classes(spark, plain.SF01).collect()
    assert grouped((r["doc_id"], r["class_id"]) for r in got) == want
    sizes = {min(g): len(g) for g in want}
    assert all(r["class_size"] == sizes[r["class_id"]] for r in got)
    assert max(sizes.values()) > 2


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("block", [4, 64])
def test_chains_hot_groups_and_awkward_rows(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rng = random.Random(6)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(50))
    base = [word() for _ in range(200)]
    docs = [None, None, "", "", "!!", "one two", "One, two", "one two three", "  "]
    docs += [edited(rng, base, rng.randrange(4)) for _ in range(40)]
    chain = [word() for _ in range(150)]
    for _ in range(12):  # each link is near the next, the ends are far apart
        docs.append(" ".join(chain))
        chain = chain[6:] + [word() for _ in range(6)]
    passage = " ".join(word() for _ in range(60))
    docs += [passage + " " + " ".join(word() for _ in range(60)) for _ in range(40)]
    docs += [" ".join(base) + "\n" + " ".join(base), docs[12], " ".join(word() for _ in range(5000))]
    rng.shuffle(docs)
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id long, text string, class_id int")
    got = near_dup.with_classes(df).collect()
    assert grouped((r["doc_id"], r["class_id"]) for r in got) == grouped(enumerate(classes(docs)))
    assert sum(r["is_first"] for r in got) == len(set(classes(docs)))
    assert near_dup.with_classes(df.limit(0)).collect() == []


def test_signatures_estimate_probability_jaccard():
    rng = random.Random(3)
    a = [rng.choice("abcdefghij") + rng.choice("klm") for _ in range(300)]
    b = a[:200] + [rng.choice("abcdefghij") + rng.choice("nop") for _ in range(120)]
    texts = [" ".join(a), " ".join(b)]
    data = "".join(texts).encode()
    table = arrays.WordTable(np.frombuffer(data, np.uint8), np.array([0, len(texts[0]), len(data)]), arrays.WORDS)
    hashes, row, weight = near_dup.shingles(table, 1)
    found = near_dup.signatures(hashes, row, weight, 2)
    pair = [(hashes[row == r], weight[row == r]) for r in (0, 1)]
    exact = near_dup.similarity(*pair)
    words = [Counter((w,) for w in t.split()) for t in texts]
    assert abs(exact - probability_jaccard(*words)) < 1e-12
    assert abs((found[0] == found[1]).mean() - exact) < 0.13


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 140)] + [(0, i) for i in range(1, 30)] + [(7, 7)]
    edges += [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert sorted(map(tuple, got)) == sorted((x, root(x)) for x in linked)
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_stars_need_no_round(spark, monkeypatch):
    written = []
    monkeypatch.setattr(components, "staged", lambda df, label: written.append(label) or df.localCheckpoint())
    stars = spark.createDataFrame([(1, 5), (1, 6), (2, 9), (2, 2)], "a long, b long")
    got = {tuple(r) for r in components.components(stars).collect()}
    assert got == {(1, 1), (5, 1), (6, 1), (2, 2), (9, 2)} and written == []
    knot = spark.createDataFrame([(1, 5), (6, 5), (5, 1), (7, 6)], "a long, b long")
    got = {tuple(r) for r in components.components(knot).collect()}
    assert got == {(1, 1), (5, 1), (6, 1), (7, 1)} and len(written) <= 2


def test_similarity_equals_the_definition():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a, b = ((np.sort(rng.choice(30, n, replace=False)).astype(np.uint64), rng.integers(1, 4, n).astype(float))
                for n in rng.integers(0, 20, 2))
        x, y = (dict(zip(t[0].tolist(), t[1].tolist())) for t in (a, b))
        every = set(x) | set(y)
        want = sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in every) for d in set(x) & set(y))
        assert abs(near_dup.similarity(a, b) - want) < 1e-12
