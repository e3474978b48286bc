"""Profiling aggregates over message, ticket and feature tables.

Each report is one scan with one grouped aggregate wherever the arithmetic allows; what needs
the data's own minimum, maximum or quantiles works on counts per distinct value, which are
merged before any shuffle.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketloom import fixed_values as fv
from ticketloom.operators.ranking import quantiles_of, staged_counts
from ticketloom.operators.routing import is_inbound

LENGTH_CAP = 280
QUARTILES = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, 100.0 * part / whole).otherwise(F.lit(0.0))


def clip_at(value: Column, cap) -> Column:
    """Values above the cap become the cap; null stays null."""
    return F.when(value > cap, cap).otherwise(value)


def null_profile(df: DataFrame) -> DataFrame:
    """Null count and share of every column that has nulls. One scan, one row, then unfolded."""
    counts = df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns],
    )
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in df.columns
    ]))
    return (
        counts.select("rows", cells.alias("_cell"))
        .select("_cell.column", "_cell.nulls", percent(F.col("_cell.nulls"), F.col("rows"))
                .alias("null_pct"))
        .filter(F.col("nulls") > 0)
    )


def direction_split(raw: DataFrame) -> DataFrame:
    """Messages per direction with shares; rows without a mark count for neither."""
    counts = raw.agg(
        F.count_if(F.col("inbound")).alias("inbound"),
        F.count_if(~F.col("inbound")).alias("outbound"),
    )
    whole = F.col("inbound") + F.col("outbound")
    return counts.select(
        F.explode(F.array(*[
            F.struct(F.lit(name).alias("direction"), F.col(name).alias("messages"),
                     percent(F.col(name), whole).alias("share_pct"))
            for name in ("inbound", "outbound")
        ])).alias("_row")
    ).select("_row.*")


def priority_summary(labeled: DataFrame) -> DataFrame:
    """One row: class counts, share, mean score and NORMAL tickets per URGENT one."""
    urgent = F.col("priority") == "URGENT"
    counts = labeled.agg(
        F.count_if(urgent).alias("urgent"),
        F.count_if(F.col("priority") == "NORMAL").alias("normal"),
        F.count("*").alias("tickets"),
        F.avg("score").alias("mean_score"),
    )
    return counts.select(
        "urgent",
        "normal",
        "tickets",
        percent(F.col("urgent"), F.col("tickets")).alias("urgent_pct"),
        F.when(F.col("urgent") > 0, F.col("normal") / F.col("urgent")).alias("normal_per_urgent"),
        "mean_score",
    )


def class_balance(table: DataFrame, target: str = "is_urgent") -> DataFrame:
    """Rows per class with the class's share of all rows."""
    counts = table.groupBy(target).agg(F.count("*").alias("rows"))
    whole = F.sum("rows").over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("share_pct", percent(F.col("rows"), whole))


def score_bands(labeled: DataFrame) -> DataFrame:
    """Tickets at the critical level (8 and up), without any signal (0), and between."""
    band = (
        F.when(F.col("score") >= 8, "critical").when(F.col("score") == 0, "silent")
        .otherwise("middle")
    )
    return labeled.groupBy(band.alias("band")).agg(F.count("*").alias("tickets"))


def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, min, quartiles and max of each column.

    Quartiles come from value counts; the rest is one plain aggregate of the table, combined before its
    one-row shuffle.
    """
    values = {c: F.col(c).cast("double") for c in columns}
    plain = df.agg(*[F.struct(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
    ).alias(c) for c, v in values.items()])
    moments = plain.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`.*")) for c in columns])).alias("_m")).select("_m.*")
    inner = {name: p for name, p in QUARTILES.items() if 0 < p < 1}
    spread = quantiles_of(staged_counts(df, columns), inner)
    return spread.join(F.broadcast(moments), "metric").select(
        "metric", "count", "mean", "std", "min", "q1", "median", "q3", "max",
    )


def weighted_means(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return counts.groupBy(*by, "metric").agg(
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean")
    )


def group_summary(df: DataFrame, group: str, column: str) -> DataFrame:
    """Count, mean, median and maximum of one column per group value."""
    counts = staged_counts(df.filter(F.col(group).isNotNull()), [column], by=[group])
    spread = quantiles_of(counts, {"median": 0.5, "max": 1.0}, by=[group])
    means = weighted_means(counts, [group])
    return spread.join(means, [group, "metric"]).select(group, "count", "mean", "median", "max")


def length_by_direction(raw: DataFrame) -> DataFrame:
    """Text length per direction, unmarked rows counted as outbound."""
    sized = raw.select(
        F.when(is_inbound(), "inbound").otherwise("outbound").alias("direction"),
        F.length("text").alias("text_len"),
    )
    return group_summary(sized, "direction", "text_len")


def box_plot(df: DataFrame, group: str, column: str) -> DataFrame:
    """Quartiles per group, with whiskers at the outermost values within 1.5 quartile ranges."""
    values = staged_counts(df.filter(F.col(group).isNotNull()), [column], by=[group])
    five = quantiles_of(values, QUARTILES, by=[group])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    within = (F.col("value") >= F.col("q1") - reach) & (F.col("value") <= F.col("q3") + reach)
    return (
        values.join(five, [group, "metric"])
        .groupBy(group, "count", *QUARTILES)
        .agg(
            F.min(F.when(within, F.col("value"))).alias("whisker_low"),
            F.max(F.when(within, F.col("value"))).alias("whisker_high"),
            F.sum(F.when(within, 0).otherwise(F.col("n"))).alias("outliers"),
        )
    )


def binned(counts: DataFrame, bins: int, low: Column, high: Column) -> DataFrame:
    """Bin numbers for (value, n) rows; the last bin is closed, a zero range has one bin."""
    width = (high - low) / F.lit(float(bins))
    position = F.when(width > 0, F.floor((F.col("value") - low) / width)).otherwise(F.lit(0))
    return counts.withColumn("bin", F.least(position, F.lit(bins - 1)).cast("int")).withColumn(
        "_width", width
    )


def histogram(df: DataFrame, column: Column | str, bins: int = 50, cap: float | None = None,
              bounds: tuple[float, float] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width histogram per `by` group: bin, bin_low, rows and density.

    Without bounds the range is each group's own minimum to maximum. Values are counted per
    distinct value first, so the range is found on those counts and the table is read once.
    """
    value = F.col(column) if isinstance(column, str) else column
    value = value.cast("double")
    if cap is not None:
        value = clip_at(value, float(cap))
    counts = (
        df.select(*by, value.alias("value"))
        .filter(F.col("value").isNotNull())
        .groupBy(*by, "value")
        .agg(F.count("*").alias("n"))
    )
    if bounds is None:
        # per group: extremes and size, combined before the shuffle and joined back
        ranges = counts.groupBy(*by).agg(
            F.min("value").alias("_low"), F.max("value").alias("_high"), F.sum("n").alias("_all")
        )
        joined = _with_group_facts(counts, ranges, by)
        low, high = F.col("_low"), F.col("_high")
    else:
        inside = (F.col("value") >= bounds[0]) & (F.col("value") <= bounds[1])
        counts = counts.filter(inside)
        sizes = counts.groupBy(*by).agg(F.sum("n").alias("_all"))
        joined = _with_group_facts(counts, sizes, by)
        low, high = F.lit(float(bounds[0])), F.lit(float(bounds[1]))
    placed = binned(joined, bins, low, high).withColumn("_low_edge", low)
    return (
        placed.groupBy(*by, "bin")
        .agg(
            F.sum("n").alias("rows"),
            F.first("_low_edge").alias("_low_edge"),
            F.first("_width").alias("_width"),
            F.first("_all").alias("_all"),
        )
        .select(
            *by,
            "bin",
            (F.col("_low_edge") + F.col("bin") * F.col("_width")).alias("bin_low"),
            "rows",
            F.when(F.col("_width") > 0, F.col("rows") / (F.col("_all") * F.col("_width")))
            .alias("density"),
        )
    )


def _with_group_facts(counts: DataFrame, facts: DataFrame, by: Sequence[str]) -> DataFrame:
    if by:
        return counts.join(facts, list(by))
    return with_one_row(counts, facts)


def with_one_row(df: DataFrame, facts: DataFrame) -> DataFrame:
    """Attach the columns of a one-row table; one row is always safe to broadcast."""
    key = F.lit(1).alias("_k")
    return df.select("*", key).join(F.broadcast(facts.select("*", key)), "_k").drop("_k")


def binary_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Which columns hold nothing but 0 and 1 (or booleans), nulls aside. One scan."""
    tests = df.agg(*[
        F.coalesce(F.bool_and(F.col(c).cast("double").isin(0.0, 1.0)), F.lit(True)).alias(c)
        for c in columns
    ])
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("is_binary")) for c in columns
    ]))
    return tests.select(cells.alias("_c")).select("_c.*")


def firing_rates(df: DataFrame, flags: Sequence[str],
                 is_urgent: Column | None = None) -> DataFrame:
    """Share in percent of rows raising each flag per class, highest URGENT rate first."""
    urgent = (F.col("priority") == "URGENT") if is_urgent is None else is_urgent
    sums = df.agg(*[
        F.struct(
            F.lit(c).alias("signal"),
            (100.0 * F.avg(F.when(urgent, F.col(c).cast("double")))).alias("urgent_pct"),
            (100.0 * F.avg(F.when(~urgent, F.col(c).cast("double")))).alias("normal_pct"),
        ).alias(c)
        for c in flags
    ])
    rows = sums.select(F.explode(F.array(*flags)).alias("_r")).select("_r.*")
    return rows.orderBy(F.desc("urgent_pct"), "signal")


def class_mean_gaps(features: DataFrame, columns: Sequence[str] = fv.FEATURES,
                    target: str = "is_urgent") -> DataFrame:
    """URGENT minus NORMAL mean of each min-max scaled feature, largest first.

    Scaling is linear, so the gap of scaled means is the gap of means over the range: one scan
    instead of scaling the table. A constant column scales to 0.
    """
    urgent = F.col(target) == 1
    cells = []
    for c in columns:
        filled = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        cells.append(F.struct(
            F.lit(c).alias("feature"),
            F.avg(F.when(urgent, filled)).alias("urgent_mean"),
            F.avg(F.when(~urgent, filled)).alias("normal_mean"),
            (F.max(filled) - F.min(filled)).alias("range"),
        ).alias(c))
    rows = features.agg(*cells).select(F.explode(F.array(*columns)).alias("_r")).select("_r.*")
    gap = F.when(
        F.col("range") > 0, (F.col("urgent_mean") - F.col("normal_mean")) / F.col("range")
    ).otherwise(F.lit(0.0))
    return rows.select("feature", gap.alias("gap")).orderBy(F.desc("gap"), "feature")


def clipped_at_p99(features: DataFrame, column: str, target: str = "is_urgent",
                   bins: int = 40) -> DataFrame:
    """Density histogram per class of a feature clipped at its overall 99th percentile."""
    filled = features.filter(F.col(target).isNotNull())
    by_class = staged_counts(filled, [column], by=[target])
    overall = by_class.groupBy("metric", "value").agg(F.sum("n").alias("n"))
    limit = quantiles_of(overall, {"p99": 0.99}).select("p99")
    counts = with_one_row(by_class.select(target, "value", "n"), limit)
    clipped = counts.select(target, clip_at(F.col("value"), F.col("p99")).alias("value"), "n")
    facts = clipped.groupBy(target).agg(
        F.min("value").alias("_low"), F.max("value").alias("_high"), F.sum("n").alias("_all")
    )
    placed = binned(clipped.join(facts, target), bins, F.col("_low"), F.col("_high"))
    return (
        placed.groupBy(target, "bin")
        .agg(F.sum("n").alias("rows"), F.first("_all").alias("_all"),
             F.first("_width").alias("_width"))
        .select(
            target, "bin", "rows",
            F.when(F.col("_width") > 0, F.col("rows") / (F.col("_all") * F.col("_width")))
            .alias("density"),
        )
    )


def split_sizes(split: DataFrame, label: str = "is_urgent") -> DataFrame:
    return split.groupBy("split", label).agg(F.count("*").alias("rows"))
