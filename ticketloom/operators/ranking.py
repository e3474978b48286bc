"""Ranks, running totals, quantiles and splits without a single-task window.

A window over a whole table, or over one dominant class, runs in one task. Here the order is cut
into key ranges; ranges are totalled, the totals (one row per range) are accumulated, and only
the position inside a range is found by a window.
"""

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.sources.tables import staged

ROWS_PER_RANGE = 1_000_000


def range_starts(df: DataFrame, key: str) -> list[float]:
    """Where to cut the order of a key: approximate quantiles, one range per million rows.

    None for a table that one task can order. The number of ranges follows the rows without a limit,
    8 bytes each: 8 MB of cuts for 10^12 rows. The cuts only balance the ranges; no result depends
    on where they fall. They are fetched once, so every reader of the plan sees the same cuts.
    """
    ranges = -(-df.count() // ROWS_PER_RANGE)
    if ranges <= 1:
        return []
    probabilities = [i / ranges for i in range(1, ranges)]
    value = F.col(key).cast("double")
    cuts = df.agg(F.percentile_approx(value, probabilities, max(10_000, 10 * ranges))).first()[0]
    return sorted(set(cuts or []))


def with_range(df: DataFrame, key: str, starts: Sequence[float]) -> DataFrame:
    """Add `_range`, the number of the range a numeric key falls in (a binary search per row).

    Comparing as doubles may put neighbours into one range but never reverses their order.
    """
    if not starts:
        return df.withColumn("_range", F.lit(0.0))
    splits = [float("-inf"), *sorted({float(s) for s in starts}), float("inf")]
    search = Bucketizer(splits=splits, inputCol="_key", outputCol="_range", handleInvalid="keep")
    return search.transform(df.withColumn("_key", F.col(key).cast("double"))).drop("_key")


def running_total(df: DataFrame, key: str, weight: str, by: Sequence[str] = (),
                  out: str = "running", starts: Sequence[float] | None = None,
                  tie: Sequence[str] = ()) -> DataFrame:
    """Add the total of `weight` over all rows up to and including this one, in key order.

    `key` is numeric; `by` columns restart the total; neither may be null. Rows with equal keys
    are ordered by `tie`; group repeated keys first when they may be frequent. The input is read
    more than once: stage it when it is costly.
    """
    starts = range_starts(df, key) if starts is None else starts
    ranged = with_range(df, key, starts)
    totals = ranged.groupBy(*by, "_range").agg(F.sum(weight).alias("_total"))
    earlier = (
        Window.partitionBy(*(by or [F.lit(1)]))
        .orderBy("_range")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *by, "_range", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before")
    )
    inside = (
        Window.partitionBy(*by, "_range")
        .orderBy(key, *tie)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = ranged.withColumn("_inside", F.sum(weight).over(inside))
    return (
        placed.join(offsets, [*by, "_range"])
        .withColumn(out, F.col("_before") + F.col("_inside"))
        .select(*df.columns, out)
    )


def dense_ids(df: DataFrame, key: str, out: str = "point_id",
              tie: Sequence[str] = ()) -> DataFrame:
    """Number the rows 0, 1, 2, ... in key order."""
    counted = running_total(df.withColumn("_one", F.lit(1).cast("long")), key, "_one",
                            out="_upto", tie=tie)
    return counted.withColumn(out, F.col("_upto") - 1).drop("_one", "_upto")


def value_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Long form (by..., metric, value, n) of several numeric columns, equal values merged.

    Nulls are left out. Repeated values collapse before the shuffle.
    """
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
        for c in columns
    ]))
    return (
        df.select(*by, cells.alias("_cell"))
        .select(*by, "_cell.metric", "_cell.value")
        .filter(F.col("value").isNotNull())
        .groupBy(*by, "metric", "value")
        .agg(F.count("*").alias("n"))
    )


def staged_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """`value_counts`, written once: whatever is derived from them reads the input one time."""
    return staged(value_counts(df, columns, by), "value-counts")


def quantiles_of(counts: DataFrame, probabilities: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated quantiles per (by..., metric) of staged counts.

    Exact at any size: distinct values carry their counts, and ranks come from running totals
    over key ranges, so no task sees a whole group.
    """
    groups = (*by, "metric")
    ranked = running_total(counts, "value", "n", by=groups, out="_upto")
    sizes = counts.groupBy(*groups).agg(F.sum("n").alias("_size"))
    sized = ranked.join(sizes, list(groups))
    picks, outputs = [], []
    for name, p in probabilities.items():
        position = (F.col("_size") - 1) * F.lit(float(p))
        low, high = F.floor(position), F.ceil(position)
        picks += [
            F.min(F.when(F.col("_upto") > low, F.col("value"))).alias(f"_low_{name}"),
            F.min(F.when(F.col("_upto") > high, F.col("value"))).alias(f"_high_{name}"),
        ]
        share = position - low
        outputs.append(
            (F.col(f"_low_{name}") + (F.col(f"_high_{name}") - F.col(f"_low_{name}")) * share)
            .alias(name)
        )
    return sized.groupBy(*groups, "_size").agg(*picks).select(
        *groups, F.col("_size").alias("count"), *outputs
    )


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: dict[str, float],
                    by: Sequence[str] = ()) -> DataFrame:
    """Quantiles per (by..., metric), one output column per name; the input is read once."""
    return quantiles_of(staged_counts(df, columns, by), probabilities, by)


def seeded_hash(key: str, seed: int) -> Column:
    """A reproducible order that any engine can recompute."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in seeded order; a top-n, so no full sort."""
    return df.orderBy(seeded_hash(key, seed), key).limit(n)


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.orderBy(key).limit(n)


def stratified_split(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """Add `split`: train / validation / test at 60 / 20 / 20 within every label value.

    Sizes per class are exact: train takes the rounded 60 %, validation half of the rest. The
    cut points are found from hash ranges, whose number follows the rows, then exactly inside the
    ranges they fall in. The table itself is never sorted or shuffled; it meets only the cut points,
    which are one row per class. Rows without a label belong to no class and are refused. Sizes
    are exact for unique keys; rows that share a key share a split.
    """
    rows, unlabelled = df.agg(F.count("*"), F.count_if(F.col(label).isNull())).first()
    if unlabelled:
        raise ValueError(f"{unlabelled} of {rows} rows have no {label}")
    digits = 3  # hex digits of the hash; each more makes 16 times as many ranges
    while rows > ROWS_PER_RANGE * 16 ** digits:
        digits += 1
    hashed = df.select(label, seeded_hash(key, seed).alias("_hash")).withColumn(
        "_range", F.substring("_hash", 1, digits)
    )
    per_range = hashed.groupBy(label, "_range").agg(F.count("*").alias("_rows"))
    per_class = Window.partitionBy(label)
    upto = per_class.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = per_range.select(
        label,
        "_range",
        "_rows",
        F.sum("_rows").over(upto).alias("_upto"),
        F.sum("_rows").over(per_class).alias("_size"),
    )
    train = F.floor((F.col("_size") * 6 + 5) / 10)
    ranks = placed.withColumn("_train", train).withColumn(
        "_rank",
        F.explode(F.array(
            F.col("_train"),
            F.col("_train") + F.floor((F.col("_size") - F.col("_train")) / 2),
        )),
    )
    is_here = (F.col("_rank") > F.col("_upto") - F.col("_rows")) & (F.col("_rank") <= F.col("_upto"))
    # At most two rows per class, so the broadcast is bounded by the number of classes.
    cuts = ranks.filter(is_here).select(
        label,
        "_range",
        (F.col("_rank") - (F.col("_upto") - F.col("_rows"))).alias("_local"),
        (F.col("_rank") == F.col("_train")).alias("_is_train"),
    )
    candidates = hashed.join(F.broadcast(cuts.select(label, "_range").distinct()),
                             [label, "_range"])
    in_range = Window.partitionBy(label, "_range").orderBy("_hash")
    ranked = candidates.withColumn("_local", F.row_number().over(in_range))
    bounds = (
        ranked.join(F.broadcast(cuts), [label, "_range", "_local"])
        .groupBy(label)
        .agg(
            F.max(F.when(F.col("_is_train"), F.col("_hash"))).alias("_train_end"),
            F.max("_hash").alias("_validation_end"),
        )
    )
    position = seeded_hash(key, seed)
    split = (
        F.when(position <= F.col("_train_end"), "train")
        .when(position <= F.col("_validation_end"), "validation")
        .otherwise("test")
    )
    return (
        df.join(F.broadcast(bounds), label, "left")
        .withColumn("split", split)
        .select(*df.columns, "split")
    )
