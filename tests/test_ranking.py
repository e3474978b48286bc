"""Range-cut ranks, quantiles, ids and splits against direct computation."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ticketloom.operators import ranking as rk


@pytest.mark.parametrize("starts", [None, [], [3], [2, 2.5, 7, 40]])
def test_running_total_does_not_depend_on_the_ranges(spark, starts):
    values = [5, 1, 9, 3, 2, 40, 41, 7]
    df = spark.createDataFrame([(v, v * 10, "a" if v % 2 else "b") for v in values],
                               "k int, w long, g string")
    got = {r["k"]: r["running"] for r in rk.running_total(df, "k", "w", starts=starts).collect()}
    total, expected = 0, {}
    for v in sorted(values):
        total += v * 10
        expected[v] = total
    assert got == expected
    by = rk.running_total(df, "k", "w", by=["g"], starts=starts)
    assert {r["k"]: r["running"] for r in by.collect()}[40] == (2 + 40) * 10


def test_ranges_are_monotone(spark):
    starts = [1, 4, 9, 16, 25]
    rows = rk.with_range(spark.range(0, 30), "id", starts).collect()
    assert [r["_range"] for r in rows] == [np.searchsorted(starts, r["id"], "right") for r in rows]


def test_large_ids_keep_their_order(spark, monkeypatch):
    monkeypatch.setattr(rk, "ROWS_PER_RANGE", 10)
    base = 2 ** 53
    df = spark.range(0, 100, 1, 4).select((F.col("id") + base).alias("k"))
    rows = rk.dense_ids(df, "k").orderBy("k").collect()
    assert [r["point_id"] for r in rows] == list(range(100))


def test_dense_ids_are_dense_and_ordered(spark, monkeypatch):
    monkeypatch.setattr(rk, "ROWS_PER_RANGE", 300)
    df = spark.range(0, 5000, 1, 7).select((F.xxhash64("id") % 100_000).alias("k")).distinct()
    rows = rk.dense_ids(df, "k").orderBy("k").collect()
    assert [r["point_id"] for r in rows] == list(range(len(rows)))


def test_dense_ids_number_repeated_keys_once_each(spark):
    df = spark.range(0, 300).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
    ids = [r["point_id"] for r in rk.dense_ids(df, "k", tie=("id",)).collect()]
    assert sorted(ids) == list(range(300))


@settings(max_examples=6, deadline=None)
@given(st.lists(st.one_of(st.integers(-5, 5).map(float), st.floats(-1e6, 1e6)),
                min_size=1, max_size=60))
def test_quantiles_equal_linear_interpolation(spark, values):
    df = spark.createDataFrame([(float(v), "g") for v in values], "x double, g string")
    probabilities = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0}
    row = rk.exact_quantiles(df, ["x"], probabilities, by=["g"]).first()
    for name, p in probabilities.items():
        assert row[name] == pytest.approx(np.quantile(np.array(values) + 0.0, p), rel=1e-9, abs=1e-9)
    assert row["count"] == len(values)


def test_quantiles_with_many_ranges_and_a_dominant_value(spark, monkeypatch):
    monkeypatch.setattr(rk, "ROWS_PER_RANGE", 100)
    df = spark.range(0, 9000, 1, 5).select(
        F.when(F.col("id") % 3 == 0, 500.0).otherwise((F.col("id") * 7919 % 10_007).cast("double"))
        .alias("x"))
    values = [r["x"] for r in df.collect()]
    row = rk.exact_quantiles(df, ["x"], {"q1": 0.25, "m": 0.5, "q3": 0.75}).first()
    assert [row["q1"], row["m"], row["q3"]] == pytest.approx(
        list(np.quantile(values, [0.25, 0.5, 0.75])))


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 2, "b": 3}, {"a": 58, "b": 341}, {"x": 5000}])
def test_split_is_exact_disjoint_and_stratified(spark, sizes):
    rows = [(i, name) for name, n in sizes.items() for i in range(n)]
    rows = [(j, name) for j, (_, name) in enumerate(rows)]
    split = rk.stratified_split(spark.createDataFrame(rows, "id long, c string"), "c", "id").collect()
    assert len(split) == len(rows)
    for name, n in sizes.items():
        order = sorted((hashlib.md5(f"42:{i}".encode()).hexdigest(), i) for i, c in rows if c == name)
        train = (6 * n + 5) // 10
        held = train + (n - train) // 2
        expected = {i: "train" if p < train else "validation" if p < held else "test"
                    for p, (_, i) in enumerate(order)}
        assert {r["id"]: r["split"] for r in split if r["c"] == name} == expected


def test_split_moves_only_boundary_rows(spark):
    df = spark.range(0, 20_000, 1, 4).select("id", (F.col("id") % 5 == 0).cast("int").alias("c"))
    plan = rk.stratified_split(df, "c", "id")._jdf.queryExecution().executedPlan().toString()
    top = plan[:plan.index("BroadcastExchange")]
    assert "Exchange hashpartitioning" not in top and "Sort" not in top


def test_seeded_sample_is_reproducible(spark):
    df = spark.range(0, 1000)
    first = [r["id"] for r in rk.seeded_sample(df, "id", 10).collect()]
    again = [r["id"] for r in rk.seeded_sample(df.repartition(7), "id", 10).collect()]
    other = [r["id"] for r in rk.seeded_sample(df, "id", 10, seed=1).collect()]
    assert first == again != other and len(set(first)) == 10
    assert [r["id"] for r in rk.first_rows(df, "id", 3).collect()] == [0, 1, 2]
