"""Roll-ups of the audit log."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.operators.ranking import exact_quantiles

LATENCIES = ("rag_latency_ms", "non_rag_latency_ms", "llm_latency_ms")
COSTS = ("rag_cost_usd", "non_rag_cost_usd", "llm_cost_usd")
LABELS = ("URGENT", "NORMAL", "UNAVAILABLE")


def roll_up(log: DataFrame) -> DataFrame:
    """One row: calls, low-similarity share, label agreement, total costs."""
    both = F.col("ml_label").isin("URGENT", "NORMAL") & F.col("llm_label").isNotNull()
    return log.agg(
        F.count("*").alias("calls"),
        F.count_if("low_similarity").alias("low_similarity_calls"),
        (100.0 * F.avg(F.col("low_similarity").cast("int"))).alias("low_similarity_pct"),
        F.count_if(both).alias("compared"),
        F.count_if(both & (F.col("ml_label") == F.col("llm_label"))).alias("agreed"),
        *[F.sum(c).alias(f"total_{c}") for c in COSTS],
    )


def latency_quantiles(log: DataFrame) -> DataFrame:
    """Median, 95th and 99th percentile of every latency."""
    return exact_quantiles(log, LATENCIES, {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def agreement_matrix(log: DataFrame) -> DataFrame:
    """Calls per pair of labels, the completion's label across."""
    return (
        log.filter(F.col("ml_label").isNotNull())
        .groupBy("ml_label")
        .agg(*[
            F.count_if(F.col("llm_label") == name).alias(f"llm_{name.lower()}")
            for name in LABELS[:2]
        ])
    )
