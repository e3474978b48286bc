import hashlib
import random
import re

import plain
import pytest

from ticketloom.llm import catalog, prefix_trie, ranges

KIND = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Every node by its list of turns, every total by walking down."""
    own = {}
    for conv_id, turn, role, text in rows:
        role, text = role or "", text or ""
        if conv_id is not None:
            mark = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(conv_id, []).append((turn is not None, turn or 0, role, mark, text))
    own = {c: [(r[2], r[4]) for r in sorted(rows)] for c, rows in own.items()}
    full = {}
    for c in own:
        lender = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        h = plain.crc(str(c).encode()) % 4
        full[c] = own.get(lender, [])[:h] + own[c][h:]
    members, children = {}, {}
    for c, seq in full.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[b] for b in below) or 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[b] for b in below)
    out = []
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(full[c]) == len(node))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who),
                    len(children.get(node, [])), leaves[node], saved[node], plain.sha(ends)))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, prefix_trie.digest(df).collect()), key=repr)


@pytest.mark.parametrize("sf", [plain.SF, plain.SF01])
def test_given_tables(spark, sf):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in plain.rows("conversations", sf)]
    found = catalog.op11_prefix_trie(spark, sf)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                             "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows)


def test_chains_bushes_copies_and_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", 3)
    rng = random.Random(3)
    rows = [(7, t, "user", f"turn {t} of one long chain") for t in range(150)]
    rows += [(27, t, "user", f"turn {t} of one long chain") for t in range(100)]
    # conversations that begin alike and end in thousands of ways, and whole copies
    for c in range(40, 400):
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a b", "c", "d e f"]))
                 for t in range(rng.randrange(1, 6))]
    rows += [(c, t, "user", f"copy {t}") for c in range(400, 480) for t in range(4)]
    rows += [(500, None, None, None), (500, None, "user", None), (500, 0, "", "\t \x0b"), (500, 0, "", "x"),
             (500, 0, "", "x"), (None, 1, "user", "lost"), (-7, 2, "user", "négative é"), (-20, 0, "user", "b"),
             (-20, 1, "user", "c"), (501, 5, "user", "word " * 30_000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, KIND)
    assert got(df.repartition(5)) == brute(rows)


def test_extra_columns_repeats_and_empty_tables(spark):
    rows = [(c, t, "user", "same") for c in (1, 2, 3, 21) for t in (0, 0, 1)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows],
                               KIND + ", key string, depth int, part int")
    assert got(df) == brute(rows)
    assert got(df.limit(0)) == []


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    paths = []
    real = prefix_trie.scratch_path
    monkeypatch.setattr(prefix_trie, "scratch_path", lambda s, label: paths.append(label) or real(s, label))
    n = 1000
    tree = spark.range(n).selectExpr("0L conv_id", "id depth", "if(id = 0, null, 0L) up_conv",
                                     "if(id = 0, null, id - 1) up_depth",
                                     f"if(id = {n - 1}, 0L, 1L) kids", "1L one", "id two")
    totals = {r["depth"]: (r["one"], r["two"]) for r in
              prefix_trie.subtree_totals(tree, "one", "two").collect()}
    assert totals == {d: (n - d, sum(range(d, n))) for d in range(n)}
    assert paths.count("contracted") < 30


def test_running_totals_split_one_group(spark):
    df = spark.createDataFrame([(1, i) for i in range(500)], "g int, v long").repartition(4)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        parts = ranges.in_ranges(df.repartition(7), "g", "v")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    from pyspark.sql import functions as F
    out = ranges.with_totals(parts, ["g"], "part", ["v"], {"before": F.col("v")}).collect()
    assert {r["v"]: r["before"] for r in out} == {v: sum(range(v)) for v in range(500)}
