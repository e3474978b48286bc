import random
import re
from collections import Counter, defaultdict

import plain
import pytest
from pyspark.sql import functions as F

from ticketloom.llm import catalog, mixing, ranges

KIND = "doc_id long, source string, text string"


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes, weights=(5, 2, 1), share=1.5):
    """Reshare by weight what passes a cap until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    free, capped, budget = set(names), {}, share * sum(sizes.values())
    while free:
        rest = (budget - sum(capped.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * rest > 2 * sizes[s]}
        if not over:
            return capped | {s: weight[s] * rest for s in free}
        capped |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    return capped


def check(rows, found):
    """rows (doc_id, source, text); the contract's laws."""
    sizes = defaultdict(int)
    for _, source, text in rows:
        sizes[source] += size(text)
    want, by_target = brute_targets(sizes), defaultdict(list)
    assert len(found) == len(rows)
    expected = Counter((d, size(t), sizes[s], round(want[s], 6)) for d, s, t in rows)
    assert Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in found) == expected
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in found)
    source_of = {d: s for d, s, _ in rows}
    if len(source_of) == len(rows):
        for r in found:
            by_target[source_of[r["doc_id"]]].append(r["taken"])
        for s, taken in by_target.items():
            assert abs(sum(taken) - want[s]) <= 0.5 + 1e-6


@pytest.mark.parametrize("sf", [plain.SF, plain.SF01])
def test_given_tables(spark, sf):
    rows = [(r["doc_id"], r["source"], r["text"]) for r in plain.rows("documents", sf)]
    found = catalog.op12_source_mix(spark, sf)
    assert found.columns == ["doc_id", "size", "source_size", "target", "taken"]
    found = found.collect()
    check(rows, found)
    assert Counter(found) == Counter(catalog.op12_source_mix(spark, sf).collect())


def awkward():
    rng = random.Random(2)
    rows = [(i, f"s{i % 7}", "w " * rng.randrange(0, 60)) for i in range(300)]
    rows += [(1000 + i, "hot", "a b\tc\x0bd" * rng.randrange(1, 40)) for i in range(300)]
    rows += [(2000, None, "x y"), (2001, "", None), (2002, "é", ""), (2003, "\U0001F600", "z"),
             (2004, "huge", "long " * 50_000), (2005, "nothing", " \t ")]
    return rows


def test_awkward_documents(spark, monkeypatch):
    monkeypatch.setattr(ranges, "RANGE_ROWS", 50)
    monkeypatch.setattr(mixing, "RANGE_ROWS", 20)
    rows = awkward()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], KIND + ", place int, size int")
    check(rows, mixing.digest(df.repartition(3)).collect())


def test_repeated_rows_null_ids_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 30)
    rows = [(None, "a", "w " * 9)] * 100 + [(5, "a", "w")] * 70 + [(5, None, "v")] * 3
    df = spark.createDataFrame(rows, KIND)
    found = mixing.digest(df).collect()
    check(rows, found)
    assert sum(r["taken"] for r in found) == sum(int(t + 0.5) for t in brute_targets(
        {"a": 970, None: 3}).values())
    assert mixing.digest(df.limit(0)).collect() == []
    assert [r["taken"] for r in mixing.digest(spark.createDataFrame([(1, "a", " ")], KIND)).collect()] == [0]


def test_slots_fill_every_block_once_and_keep_the_proportions(spark):
    docs = mixing.sized(spark.createDataFrame(awkward(), KIND), "doc_id", "source",
                        mixing.word_count(F.col("text")))
    sources = mixing.targets(docs)
    need = {r["place"]: r["need"] for r in sources.collect()}
    block = 16
    slots = mixing.schedule(sources, block).orderBy("slot").collect()
    ranks = defaultdict(list)
    for r in slots:
        ranks[r["place"]].append(r["rank"])
    for place, n in need.items():
        assert ranks[place] == list(range(-(-n // block)))
    # in every stretch from the start a source has its share of slots, give or take a few
    total, seen = sum(need.values()), Counter()
    for r in slots[:total // block]:
        seen[r["place"]] += 1
        done = r["slot"] + 1
        assert abs(seen[r["place"]] - done * need[r["place"]] / total) < 8


def test_pieces_give_whole_documents_once_per_pass(spark):
    rows = awkward()
    docs = mixing.sized(spark.createDataFrame(rows, KIND), "doc_id", "source",
                        mixing.word_count(F.col("text")))
    sources = mixing.targets(docs)
    need = {r["place"]: (r["need"], r["source_size"]) for r in sources.collect()}
    spans, filled = defaultdict(list), Counter()
    for r in mixing.mix(docs, sources, 16).collect():
        spans[r["place"], r["doc_id"], r["epoch"]].append((r["first"], r["n"], r["size"]))
        filled[r["place"], r["slot"]] += r["n"]
    assert max(filled.values()) == 16
    for (place, _, epoch), found in spans.items():
        at = 0
        for first, n, whole in sorted(found):
            assert first == at and n > 0
            at += n
        if (epoch + 1) * need[place][1] <= need[place][0]:
            assert at == whole


def test_native(spark):
    df = catalog.op12_source_mix(spark, plain.SF)
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", df._jdf.queryExecution().toString())
