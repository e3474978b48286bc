import math
import random

import plain

from ticketloom.llm import catalog, topk


def brute(rows, every=100, k=10):
    vectors = []
    for r in rows:
        v = r["embedding"]
        if r["vec_id"] is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        vectors.append((r["vec_id"], [math.floor(1024 * x) for x in v]))
    out = []
    for own, (q, a) in enumerate(vectors):
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for n, (i, b) in enumerate(vectors) if n != own)
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_given_table(spark):
    got = catalog.op3_branch_and_bound_topk(spark, plain.SF01)
    assert sorted(map(tuple, got.collect())) == brute(plain.rows("embeddings", plain.SF01))


def test_awkward_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "GROUP_ROWS", 16)
    monkeypatch.setattr(topk, "GROUP_QUERIES", 3)
    monkeypatch.setattr(topk, "MERGED_GROUPS", 2)
    rng = random.Random(4)
    vectors = [[rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(rng.choice([3, 20]))] for _ in range(60)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(7, vectors[8]), (7, vectors[8]), (None, [1.0]),
            (100, None), (101, [None, 1.0]), (102, [float("nan")]), (103, [float("inf")]), (104, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    want = brute([dict(vec_id=i, embedding=v) for i, v in rows], every=5)
    assert sorted(map(tuple, topk.digest(df, every=5).collect())) == want
    assert topk.digest(df.limit(0)).collect() == []
    few = topk.digest(df.filter("vec_id in (0, 1, 2)"), every=2).collect()
    assert sorted(r["rank"] for r in few) == [1, 1, 2, 2]


def test_large_components_take_part(spark):
    rng = random.Random(6)
    for most, small in ((3e4, None), (4e5, None), (3e5, 1.0), (1e12, 1e-2)):
        # scores must fit a long: where vectors are large, the queries are small
        rows = [(i, [rng.uniform(-1, 1) * (most if i % 100 or not small else small) for _ in range(12)])
                for i in range(150)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        want = brute([dict(vec_id=i, embedding=v) for i, v in rows])
        assert len(want) == 20 and sorted(map(tuple, topk.digest(df).collect())) == want


def test_repeated_ids_all_take_part_and_the_twin_agrees(spark, tmp_path):
    import duckdb

    rows = [(100, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.25, 1.0]), (100, [0.0, 1.0]), (200, None)]
    rows += [(1, [0.5, 0.0])] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, topk.digest(df).collect()))
    assert got == brute([dict(vec_id=i, embedding=v) for i, v in rows])
    assert (100, 1, 1, 1048576) in got and len(got) == 14
    df.write.parquet(str(tmp_path / "embeddings"))
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings/*.parquet')")
    assert sorted(db.execute(topk.ORACLE).fetchall()) == got
