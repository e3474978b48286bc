"""Hash tables, threshold joins and tables with snapshots."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketloom.operators import lsh
from ticketloom.operators import similarity as sim
from ticketloom.operators import threshold as th
from ticketloom.plans import population
from ticketloom.session import scratch_path
from ticketloom.sources import files, snapshots

KIND = "point_id long, vector array<double>"


def clustered(n=600, dim=12, spread=0.25, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(15, dim))
    return [(i, list(map(float, centres[i % 15] + spread * rng.normal(size=dim)))) for i in range(n)]


def near_pairs(asked, rows, threshold):
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v is not None and any(v)}
    first = {}
    for i in sorted(unit):
        first.setdefault(tuple(dict(rows)[i]), i)
    reps = sorted(set(first.values()))
    wanted = {first[tuple(dict(rows)[i])] for i in asked if i in unit}
    return {(a, b) for a in wanted for b in reps if a != b and round(float(unit[a] @ unit[b]), 10) >= threshold}


@pytest.mark.parametrize("threshold", [0.2, 0.8, 0.95])
def test_threshold_join_equals_all_pairs(spark, threshold):
    rows = clustered() + [(1000 + i, clustered()[3][1]) for i in range(200)]
    rows += [(2000, [0.0] * 12), (2001, None), (2002, [-x for x in clustered()[5][1]])]
    df = spark.createDataFrame(rows, KIND)
    known = th.classes(df)
    asked = known.join(df.filter("point_id % 5 = 0").select("vector").distinct(), "vector", "left_semi")
    joined = th.similarity_join(asked, known, threshold, th.fit_pivots(df.filter("vector is not null"), 15),
                                block_rows=7, group_queries=11)
    got = [(r["query_id"], r["hit_id"]) for r in joined.pairs.collect()]
    assert len(got) == len(set(got))
    assert set(got) == near_pairs([i for i, _ in rows if i % 5 == 0], rows, threshold)
    report = joined.report.first()
    assert report["visited"] + report["skipped"] == report["queries"] * report["blocks"]
    if threshold > 0.7:  # clusters lie apart: most blocks are never read
        assert report["skipped"] > 0.8 * report["queries"] * report["blocks"]
    assert {(r["point_id"], r["class_id"]) for r in th.membership(df, known).collect()} >= {
        (1000 + i, 3) for i in range(200)}


def test_threshold_join_of_nothing_and_bad_thresholds(spark):
    df = spark.createDataFrame(clustered(40), KIND)
    known, pivots = th.classes(df), th.fit_pivots(df, 4)
    none = known.filter("class_id < 0")
    assert th.similarity_join(none, known, 0.5, pivots).pairs.collect() == []
    assert th.similarity_join(known, none, 0.5, pivots).pairs.collect() == []
    with pytest.raises(ValueError):
        th.similarity_join(known, known, 1.5, pivots)


def test_no_cross_join(spark):
    df = spark.createDataFrame(clustered(60), KIND)
    known = th.classes(df)
    pairs = th.similarity_join(known, known, 0.9, th.fit_pivots(df, 4)).pairs
    assert "CartesianProduct" not in pairs._jdf.queryExecution().toString()


def test_probes_are_ordered_by_the_cost_of_their_flips():
    hashing = lsh.Hashing(6, tables=3, bits=4)
    vectors = np.random.default_rng(2).normal(size=(20, 6))
    margins, own, probes = hashing.margins(vectors), hashing.codes(vectors), hashing.probes(vectors, 16)
    assert (probes[:, :, 0] == own).all()
    for q in range(20):
        for t in range(3):
            assert sorted(probes[q, t]) == list(range(t * 16, t * 16 + 16))
            cost = [sum(abs(margins[q, t, b]) for b in range(4) if (c ^ own[q, t]) >> b & 1) for c in probes[q, t]]
            assert cost == sorted(cost)


def test_hash_search_recall_and_hot_buckets(spark):
    rows = clustered(900) + [(5000 + i, clustered()[7][1]) for i in range(500)]
    df = spark.createDataFrame(rows, KIND)
    hashing = lsh.Hashing(12, tables=4, bits=6)
    index = lsh.write_index(lsh.with_codes(df, hashing), scratch_path(spark, "index"), block_rows=50)
    hot = index.groupBy("code").agg(F.max("salts").alias("salts"), F.count_distinct("salt").alias("used"))
    assert hot.filter("salts > 8 and used > 8").count() >= 4
    asked = df.filter("point_id % 50 = 0")
    options = {"query_id": "point_id", "skip_same_id": True}
    probes = lsh.probes_for(asked, df, hashing, **options)
    assert 1 <= probes < 64
    exact = {(r["query_id"], r["hit_id"]) for r in sim.top_k(asked, df, 12, **options).collect()}
    found = lsh.top_k(asked, index, hashing, probes, **options)
    got = {(r["query_id"], r["hit_id"]) for r in found.collect()}
    assert len(exact & got) >= 0.9 * len(exact)
    assert max(r["rank"] for r in found.collect()) <= 5
    whole = lsh.top_k(asked, index, hashing, 64, **options)
    assert {(r["query_id"], r["hit_id"]) for r in whole.collect()} == exact


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_registered_recall(spark, sf):
    from ticketloom.catalog import retrieval
    assert retrieval.lsh_recall(spark, sf).first()["recall"] >= 0.9


def points(spark, ids, label):
    return spark.createDataFrame([(i, [float(i)], label) for i in ids], "point_id long, vector array<float>, label int")


def content(df):
    return {r["point_id"]: r["label"] for r in df.collect()}


def new_table(spark, ids=range(40)):
    path = scratch_path(spark, "table")
    assert snapshots.create(spark, path, points(spark, [], 0).schema)
    snapshots.change(spark, path, points(spark, ids, 0), shard_points=10)
    return path


def test_a_failed_commit_leaves_the_old_snapshot(spark, monkeypatch):
    path = new_table(spark)
    before = content(snapshots.read(spark, path))
    reader = snapshots.read(spark, path)

    def crash(*_):
        raise OSError("lost before the commit")

    with monkeypatch.context() as broken:
        broken.setattr(files, "commit_json", crash)
        with pytest.raises(OSError):
            snapshots.change(spark, path, points(spark, range(5, 25), 1), shard_points=10)
    assert snapshots.versions(spark, path) == [0, 1] and content(snapshots.read(spark, path)) == before
    made = snapshots.change(spark, path, points(spark, range(5, 25), 2), shard_points=10)
    assert made.number == 2 and made.parent == 1 and made.points == 40
    assert content(reader) == before  # an opened snapshot does not move
    assert content(snapshots.read(spark, path, 1)) == before
    assert content(snapshots.read(spark, path)) == before | {i: 2 for i in range(5, 25)}


def test_untouched_shards_keep_their_files(spark):
    path = new_table(spark)
    old = snapshots.snapshot(spark, path)
    new = snapshots.change(spark, path, points(spark, [3, 1003], 7), points(spark, [12, 13], 0), shard_points=10)
    assert {s for s in old.shards if new.shards.get(s) == old.shards[s]} == {2, 3}
    assert content(snapshots.read(spark, path)) == {i: 0 for i in range(40) if i not in (12, 13)} | {3: 7, 1003: 7}
    emptied = snapshots.change(spark, path, gone=points(spark, range(20, 30), 0), shard_points=10)
    assert 2 not in emptied.shards and emptied.points == 29
    with pytest.raises(ValueError):
        snapshots.change(spark, path, points(spark, [1, 1], 0))


def test_changes_that_race(spark, monkeypatch):
    path, real = new_table(spark), files.commit_json
    for ids, label in (([35], 8), ([5], 9)):  # another shard first, then the same one
        once = []

        def raced(session, target, value, ids=ids, label=label, once=once):
            if not once:
                once.append(1)
                monkeypatch.setattr(files, "commit_json", real)
                snapshots.change(spark, path, points(spark, ids, label), shard_points=10)
            real(session, target, value)

        monkeypatch.setattr(files, "commit_json", raced)
        snapshots.change(spark, path, points(spark, [6], label + 100), shard_points=10)
        assert content(snapshots.read(spark, path)).items() >= {ids[0]: label, 6: label + 100}.items()
    assert [s.parent for s in snapshots.history(spark, path)] == [None, 0, 1, 2, 3, 4]
    with pytest.raises(files.Taken):
        files.commit_json(spark, f"{path}/log/000000000001.json", {})


def tickets(spark, rows):
    return spark.createDataFrame(rows, "tweet_id long, airline string, text string, priority string, score int")


def test_refresh_encodes_only_what_changed(spark):
    path, encoded = scratch_path(spark, "refreshed"), []

    def encoder(column):
        return F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: (F.length(column) * i).cast("float"))

    real = population.encode

    def counting(enc, df, *rest):
        encoded.append(df.count())
        return real(enc, df, *rest)

    population.encode = counting
    try:
        first = [(i, "Delta", f"text {i}", "NORMAL", 1) for i in range(200)]
        assert population.refresh(tickets(spark, first), path, encoder) == {
            "added": 200, "changed": 0, "removed": 0, "kept": 0}
        again = population.refresh(tickets(spark, first), path, encoder)
        assert again["kept"] == 200 and encoded == [200] and len(snapshots.versions(spark, path)) == 2
        later = first[2:] + [(500, "Delta", "new", "URGENT", 9)]
        later[10] = (12, "Delta", "text 12", "URGENT", 8)
        assert population.refresh(tickets(spark, later), path, encoder) == {
            "added": 1, "changed": 1, "removed": 2, "kept": 197}
        assert encoded == [200, 2]
    finally:
        population.encode = real
    got = {r["payload"]["tweet_id"]: (r["point_id"], r["payload"]["priority"])
           for r in snapshots.read(spark, path).collect()}
    assert got == {i: (i, "NORMAL") for i in range(2, 200)} | {12: (12, "URGENT"), 500: (200, "URGENT")}
    with pytest.raises(ValueError):
        population.refresh(tickets(spark, [first[0], first[0]]), path, encoder)
