"""Completion costs and the side-by-side comparison of two classifiers."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom import fixed_values as fv


def price_table(spark) -> DataFrame:
    """One row per provider: the fixed prices in USD per million tokens."""
    rows = [(name, *pair) for name, pair in fv.PRICES.items()]
    return spark.createDataFrame(rows, "provider string, usd_in double, usd_out double")


def with_cost(calls: DataFrame, prices: DataFrame | None = None,
              out: str = "cost_usd") -> DataFrame:
    """Cost of each call from its token counts, six digits.

    Missing counts are 0 tokens. A call without a provider failed and costs 0; the cost of a
    provider that is not in the price table is unknown, so null. The default price table has two
    rows and is broadcast; for a caller's own, Spark decides by its size.
    """
    table = F.broadcast(price_table(calls.sparkSession)) if prices is None else prices
    tokens_in = F.coalesce(F.col("input_tokens"), F.lit(0))
    tokens_out = F.coalesce(F.col("output_tokens"), F.lit(0))
    cost = (tokens_in * F.col("usd_in") + tokens_out * F.col("usd_out")) / 1_000_000
    return (
        calls.join(table, "provider", "left")
        .withColumn(out, F.when(F.col("provider").isNull(), 0.0).otherwise(F.round(cost, 6)))
        .select(*calls.columns, out)
    )


def hourly_cost(cost: Column, tickets: int = fv.TICKETS_PER_HOUR) -> Column:
    return cost * F.lit(tickets)


def side_by_side(model: DataFrame, completion: DataFrame, key: str = "ticket_id") -> DataFrame:
    """Both classifiers' predictions per ticket, also where only one of them has any.

    Inputs hold (key, label, confidence, latency_ms, cost_usd), one row per ticket.
    """
    fields = ("label", "confidence", "latency_ms", "cost_usd")

    def named(df: DataFrame, prefix: str) -> DataFrame:
        have = [F.col(c).alias(f"{prefix}_{c}") for c in fields if c in df.columns]
        return df.select(key, *have)

    joined = named(model, "ml").join(named(completion, "llm"), key, "full_outer")
    return joined.withColumns({
        "agree": F.col("ml_label") == F.col("llm_label"),
        "llm_cost_per_hour": hourly_cost(F.col("llm_cost_usd")),
    })


def with_test_metrics(pairs: DataFrame, comparison: DataFrame) -> DataFrame:
    """Attach the selected model's name and test metrics.

    `comparison` has one row per candidate model, of which one is selected.
    """
    best = comparison.filter("is_best").select(
        F.lit(1).alias("_k"), F.col("model").alias("best_model"),
        "test_accuracy", "test_f1", "test_roc_auc",
    )
    return pairs.withColumn("_k", F.lit(1)).join(F.broadcast(best), "_k", "left").drop("_k")


def _digits(value: Column, places: int, unit: str = "") -> Column:
    shown = F.format_string(f"%.{places}f{unit}", value.cast("double"))
    return F.when(value.isNotNull(), shown).otherwise("—")


def _usd(value: Column, places: int = 6, unit: str = "") -> Column:
    shown = F.format_string(f"$%.{places}f{unit}", value.cast("double"))
    return F.when(value.isNotNull(), shown).otherwise("—")


def comparison_rows(pairs: DataFrame, key: str = "ticket_id") -> DataFrame:
    """The comparison as display rows (key, position, measure, ml, llm)."""
    dash = F.lit("—")
    lines = (
        ("Prediction", F.coalesce("ml_label", dash), F.coalesce("llm_label", dash)),
        ("Confidence", _digits(100 * F.col("ml_confidence"), 1, "%%"), dash),
        ("Test Accuracy", _digits(100 * F.col("test_accuracy"), 1, "%%"), dash),
        ("F1 (test)", _digits(F.col("test_f1"), 3), dash),
        ("ROC-AUC (test)", _digits(F.col("test_roc_auc"), 3), dash),
        ("Latency / call", _digits(F.col("ml_latency_ms"), 3, " ms"),
         _digits(F.col("llm_latency_ms"), 0, " ms")),
        ("Cost / call", F.lit("$0.000000"), _usd(F.col("llm_cost_usd"))),
        ("Cost @ 10,000 tickets / hr", F.lit("$0.00"),
         _usd(F.col("llm_cost_per_hour"), 2, "/hr")),
    )
    rows = F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(name).alias("measure"),
                 ml.alias("ml"), other.alias("llm"))
        for i, (name, ml, other) in enumerate(lines)
    ]))
    return pairs.select(key, rows.alias("_r")).select(key, "_r.*")
