"""Exact and approximate search, encoders and the vector table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketloom import fixed_values as fv
from ticketloom.catalog import vectors as cat
from ticketloom.catalog.messages import labeled_tickets
from ticketloom.operators import cells as ce
from ticketloom.operators import encoding as en
from ticketloom.operators import similarity as sim
from ticketloom.plans.population import populate
from ticketloom.sources import vector_table as vt


def frame(spark, matrix, first=0):
    rows = [(first + i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, "point_id long, vector array<float>").repartition(5)


def brute(queries, corpus, k, floor):
    def unit(m):
        m = np.asarray(m, np.float32).astype(float)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    found = np.round(unit(queries) @ unit(corpus).T, 10)
    out = {}
    for q, row in enumerate(found):
        order = sorted(range(len(row)), key=lambda i: (-row[i], i))[:k]
        out[q] = [i for i in order if row[i] >= floor]
    return out


def ids(hits):
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["hit_id"])
    return got


@pytest.mark.parametrize("group_queries, block_rows", [(1 << 20, 9), (5, 37), (10_000, 10_000)])
def test_search_equals_brute_force_however_it_is_cut(spark, group_queries, block_rows):
    rng = np.random.default_rng(3)
    corpus, queries = rng.normal(size=(300, 8)), rng.normal(size=(40, 8))
    corpus[100:200] = corpus[5]  # a third of the corpus are copies of one vector
    corpus[7] = 0
    queries[3] = corpus[5]
    hits = sim.top_k(frame(spark, queries), frame(spark, corpus), 8, k=6, floor=0.2,
                     query_id="point_id", group_queries=group_queries, block_rows=block_rows)
    expected = {q: h for q, h in brute(queries, corpus, 6, 0.2).items() if h}
    assert ids(hits) == expected


def test_small_pair_budget_changes_nothing(spark, sf):
    expected = ids(cat.search(spark, sf))
    rows = cat.stored_vectors(spark, sf).orderBy("point_id").collect()
    matrix = sim.unit_rows(np.array([r["vector"] for r in rows], float))
    numbers = np.array([r["point_id"] for r in rows])
    best = sim.Best.empty(len(rows))
    for start in range(0, len(rows), 33):
        part = slice(start, start + 33)
        best = sim.scan_block(best, matrix, numbers, np.arange(len(rows)), numbers[part],
                              matrix[part], 5, 0.3, True)
    got = {}
    for q, h in zip(best.query, best.hit):
        got.setdefault(int(numbers[q]), []).append(int(h))
    assert got == expected


@pytest.mark.parametrize("rows, size, pieces", [
    (0, 10, 1), (40, 10, 4), (1_000, 10, 8), (100_000, 150, 8), (400_001, 150, 9), (2_000_000, 150, 40)])
def test_copies_of_a_row_stay_few(spark, rows, size, pieces):
    assert sim.pieces_of(spark.range(rows), size) == pieces


def test_small_steps_and_repeated_ids_change_nothing(monkeypatch):
    rng = np.random.default_rng(5)
    vectors = rng.integers(-2, 3, (400, 4)).astype(float)  # many equal ones
    unit, numbers = sim.unit_rows(vectors), np.repeat(np.arange(200), 2)
    products = np.round(unit @ unit.T, 10)
    products[numbers[:, None] == numbers] = -1
    monkeypatch.setattr(sim, "STEP_QUERIES", 7)
    monkeypatch.setattr(sim, "STEP_ROWS", 11)
    best = sim.Best.empty(400)
    for start in range(0, 400, 90):
        part = slice(start, start + 90)
        for which in (np.arange(399, 150, -1), np.arange(151)):
            best = sim.scan_block(best, unit, numbers, which, numbers[part], unit[part], 5, 0.2, True)
    for q in range(400):
        order = sorted(range(400), key=lambda i: (-products[q, i], numbers[i]))[:5]
        mine = best.query == q
        assert list(zip(best.hit[mine], best.similarity[mine])) == [
            (numbers[i], products[q, i]) for i in order if products[q, i] >= 0.2]


def test_a_cell_meets_the_queries_in_groups(spark, sf, monkeypatch):
    monkeypatch.setattr(sim, "GROUP_QUERIES", 60)
    held, scan = [], sim.scanned

    def watched(left, right, keys, *others, **options):
        held.append(max(r["count"] for r in left.groupBy(*keys).count().collect()))
        return scan(left, right, keys, *others, **options)

    monkeypatch.setattr(sim, "scanned", watched)
    stored = cat.stored_vectors(spark, sf)
    found = cat.cell_topk_all(spark, sf).orderBy("query_id", "rank").collect()
    assert max(held) < stored.count() / 2
    expected = cat.cosine_topk(spark, sf).select("query_id", "rank", "hit_id").orderBy("query_id", "rank")
    assert found == expected.collect()


def test_empty_sides(spark):
    none = frame(spark, np.ones((1, 4))).limit(0)
    some = frame(spark, np.eye(4))
    assert sim.top_k(none, some, 4, query_id="point_id").count() == 0
    assert sim.top_k(some, none, 4, query_id="point_id").count() == 0


def test_k_must_be_positive(spark):
    some = frame(spark, np.eye(4))
    with pytest.raises(ValueError):
        sim.top_k(some, some, 4, k=0, query_id="point_id")


def test_search_uses_no_cross_join_and_shuffles_each_side_once(spark, sf):
    plan = cat.search(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert plan.count("Exchange hashpartitioning") == 4 and "BroadcastExchange" not in plan
    assert "WindowGroupLimit" in plan


def test_hit_fields_are_read_from_the_shards_that_hold_hits(spark, tmp_path):
    path = str(tmp_path / "sharded")
    fields = ("tweet_id", "airline", "agent_response", "priority", "priority_score", "original_text")
    points = spark.range(0, 40).select(
        F.col("id").alias("point_id"), F.array(F.lit(1.0)).alias("vector"),
        F.struct(*[F.col("id").alias(c) for c in fields]).alias("payload"))
    vt.write_all(points, path, shard_points=10)
    hits = spark.createDataFrame([(1, 12, 0.5, 1), (1, 15, 0.4, 2)],
                                 "query_id long, hit_id long, similarity double, rank int")
    from ticketloom.sources.tables import staged

    rows = sim.hit_rows(staged(hits, "hits"), vt.read(spark, path), shard_points=10)
    assert {(r["hit_id"], r["tweet_id"]) for r in rows.collect()} == {(12, 12), (15, 15)}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "BroadcastHashJoin" in plan


def test_low_similarity(spark):
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    hits = spark.createDataFrame([(1, 0.71), (1, 0.4), (2, 0.2)], "query_id long, similarity double")
    rows = {r["query_id"]: r["low_similarity"] for r in sim.low_similarity(queries, hits).collect()}
    assert rows == {1: False, 2: True, 3: True}


def test_similarity_percent(spark):
    df = spark.createDataFrame([(0.714,), (None,)], "s double")
    assert [r[0] for r in df.select(sim.similarity_percent(F.col("s"))).collect()] == [71, 0]


def test_unit_vector(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    rows = [r[0] for r in df.select(sim.unit_vector(F.col("v"))).collect()]
    assert rows[0] == pytest.approx([0.6, 0.8]) and rows[1] == [0.0, 0.0]


def test_probing_all_cells_is_exact_and_fewer_reads_less(spark, sf):
    stored = cat.stored_vectors(spark, sf)
    model = ce.fit_cells(stored, 6, rounds=3)
    from ticketloom.session import scratch_path

    table = ce.write_cells(ce.with_cell(model, stored), scratch_path(spark, "cells"))
    assert table.count() == stored.count()
    exact = cat.search(spark, sf)
    everything = ce.cell_top_k(stored, table, model, cat.DIM, 6, query_id="point_id",
                               skip_same_id=True)
    assert ids(everything) == ids(exact)
    few = ce.cell_top_k(stored, table, model, cat.DIM, 2, query_id="point_id", skip_same_id=True)
    found = ce.recall(exact, few).first()
    assert 0.3 < found["recall"] <= 1.0
    salted = ce.cell_top_k(stored, table, model, cat.DIM, 6, query_id="point_id",
                           skip_same_id=True, block_rows=7)
    assert ids(salted) == ids(exact)


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_search_by_cell_finds_nine_tenths_of_the_exact_hits(spark, size):
    found = cat.cell_recall(spark, f"/root/testdata/{size}").first()
    print(size, found)
    assert found["recall"] >= 0.9


def test_hashing_encoder_gives_unit_vectors(spark, sf):
    rows = cat.embed_hash(spark, sf).collect()
    norms = np.linalg.norm(np.array([r["vector"] for r in rows]), axis=1)
    assert len(rows) == 368 and rows[0]["vector"] and len(rows[0]["vector"]) == fv.VECTOR_DIM
    assert norms == pytest.approx(np.ones(len(rows)), abs=1e-5)


def test_documents_are_cut_into_words_once(spark, sf):
    docs = cat.table(spark, sf, "documents").select("doc_id", "text").union(
        spark.createDataFrame([(-1, None), (-2, "?!")], "doc_id long, text string"))
    encoder = en.fit_hashing_encoder(docs, "text")
    twice = en.encode(encoder, docs, "text").select("doc_id", "vector").orderBy("doc_id").collect()
    once = en.fit_and_encode(docs, "text")
    assert once.columns == ["doc_id", "vector"] and once.orderBy("doc_id").collect() == twice
    plan = cat.embed_documents(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "documents.parquet" not in plan and "text#" not in plan


def test_texts_of_every_script_have_a_vector(spark):
    texts = ["plain words", "café müde", "где мой багаж", "我的行李在哪里", "أين حقيبتي", "naïve", "ça va"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(99, " !? ")], "id long, t string")
    encoder = en.fit_hashing_encoder(df, "t")
    rows = {r["id"]: r["vector"] for r in en.encode(encoder, df, "t").collect()}
    assert all(any(rows[i]) for i in range(len(texts))) and not any(rows[99])
    other = en.encode(encoder, spark.createDataFrame([(1, "caf m de")], "id long, t string"), "t")
    assert other.first()["vector"] != rows[1]


def load_counting_model():
    def encode(texts):
        return np.array([[len(t), t.count("a"), 1.0] for t in texts])

    return encode


def test_batch_encoder_hook(spark):
    df = spark.createDataFrame([(1, "banana"), (2, None), (3, "banana")], "id long, t string")
    encoder = en.batch_encoder(load_counting_model)
    rows = {r["id"]: r["vector"] for r in en.encode(encoder, df, "t").collect()}
    expected = np.array([6, 3, 1]) / np.linalg.norm([6, 3, 1])
    assert rows[1] == pytest.approx(list(expected), abs=1e-6) and rows[2] == [0.0, 0.0, 1.0]
    assert rows[3] == rows[1]


def test_vector_table_lifecycle(spark, tmp_path):
    path = str(tmp_path / "points")
    schema = "point_id long, vector array<float>, note string"
    assert vt.is_empty(spark, path)
    rows = spark.createDataFrame([(i, [float(i), 1.0], "old") for i in range(10)], schema)
    assert vt.create(spark, path, rows.schema) and not vt.create(spark, path, rows.schema)
    assert vt.is_empty(spark, path)
    vt.upsert(spark, path, rows, shard_points=4)
    assert vt.count(spark, path) == 10
    batch = spark.createDataFrame(
        [(3, [0.0, 0.0], "new", 1), (3, [9.0, 9.0], "newest", 2), (42, [1.0, 1.0], "new", 1)],
        schema + ", version int")
    for _ in range(2):  # repeating the batch changes nothing
        vt.upsert(spark, path, batch, "version", shard_points=4)
        got = {r["point_id"]: r["note"] for r in vt.read(spark, path).collect()}
        assert got == {**{i: "old" for i in range(10)}, 3: "newest", 42: "new"}
        assert vt.count(spark, path) == 11
    assert vt.create(spark, path, rows.schema, recreate=True) and vt.count(spark, path) == 0


def test_upsert_leaves_other_shards_alone(spark, tmp_path):
    path = tmp_path / "points"
    rows = spark.range(0, 40).select(F.col("id").alias("point_id"), F.array(F.lit(1.0)).alias("vector"))
    vt.upsert(spark, str(path), rows, shard_points=10)

    def files(shard):
        return {f.name: f.stat().st_mtime_ns for f in (path / f"shard={shard}").glob("*.parquet")}

    before = {s: files(s) for s in range(4)}
    vt.upsert(spark, str(path), rows.filter("point_id = 15"), shard_points=10)
    after = {s: files(s) for s in range(4)}
    assert before[1] != after[1] and all(before[s] == after[s] for s in (0, 2, 3))


def test_population_runs_once_unless_recreated(spark, sf, tmp_path):
    path = str(tmp_path / "tickets")
    labeled = labeled_tickets(spark, sf)
    count, encoder = populate(labeled, path, limit=20, dim=32)
    assert count == 20
    assert populate(labeled, path, encoder)[0] == 20
    assert populate(labeled, path, encoder, recreate=True)[0] == 368
    row = vt.read(spark, path).orderBy("point_id").first()
    assert row["point_id"] == 0 and len(row["vector"]) == 32
    assert row["payload"]["chunk_text"].startswith("[")
    assert row["payload"]["agent_response"] == ""  # absent columns take their defaults


def test_chunk_and_payload_defaults(spark):
    from ticketloom.operators.payload import payload_column, with_chunks

    df = spark.createDataFrame([(" Delta ", "\tmy bag  "), (None, None)], "airline string, text string")
    chunks = with_chunks(df)
    assert [r["chunk_text"] for r in chunks.collect()] == ["[Delta] my bag", "[Unknown] "]
    p = chunks.select(payload_column(chunks).alias("p")).collect()[1]["p"]
    assert (p["airline"], p["priority"], p["priority_score"], p["tweet_id"]) == (
        "Unknown", "NORMAL", 0.0, None)
    assert len(p) == 15
