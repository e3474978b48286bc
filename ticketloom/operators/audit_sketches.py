"""Roll-ups of the audit log kept per day: a new day reads that day only.

Counts and sums of days add up; latencies are kept as KLL sketches, whose merge is again a sketch. With
k = 800 a quantile's rank is off by less than RANK_ERROR of all calls (about 0.4 %, at 99 % confidence), at
any number of days; the exact path is `audit.latency_quantiles`.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.operators.audit import COSTS, LATENCIES

SKETCH_K = 800
#: Normalised rank error of a single quantile at this k, as the sketch's authors state it, rounded up.
RANK_ERROR = 0.005
COUNTS = ("calls", "low_similarity_calls", "compared", "agreed")


def _parts() -> list:
    both = F.col("ml_label").isin("URGENT", "NORMAL") & F.col("llm_label").isNotNull()
    return [
        F.count("*").alias("calls"),
        F.count_if("low_similarity").alias("low_similarity_calls"),
        F.count("low_similarity").alias("judged"),
        F.count_if(both).alias("compared"),
        F.count_if(both & (F.col("ml_label") == F.col("llm_label"))).alias("agreed"),
        *[F.sum(c).alias(f"total_{c}") for c in COSTS],
        *[F.kll_sketch_agg_double(F.col(c).cast("double"), SKETCH_K).alias(f"sketch_{c}") for c in LATENCIES],
    ]


def write_days(log: DataFrame, path: str, day: str = "day") -> None:
    """Put the days of `log` into the table, replacing these days and no others."""
    log.groupBy(day).agg(*_parts()).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def roll_up(spark: SparkSession, path: str) -> DataFrame:
    """What `audit.roll_up` gives of the whole log, from one row a day."""
    days = spark.read.parquet(path)
    whole = days.agg(*[F.sum(c).alias(c) for c in (*COUNTS, "judged")],
                     *[F.sum(f"total_{c}").alias(f"total_{c}") for c in COSTS])
    return whole.select(
        "calls", "low_similarity_calls",
        (F.lit(100.0) * F.try_divide("low_similarity_calls", "judged")).alias("low_similarity_pct"),
        "compared", "agreed", *[f"total_{c}" for c in COSTS])


def quantiles(spark: SparkSession, path: str, probabilities: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(metric, p, n, value) over all days, each value within RANK_ERROR of its rank."""
    days = spark.read.parquet(path)
    merged = days.agg(*[F.kll_merge_agg_double(f"sketch_{c}", SKETCH_K).alias(c) for c in LATENCIES])
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.lit(float(p)).alias("p"),
                 F.kll_sketch_get_n_double(c).alias("n"),
                 F.kll_sketch_get_quantile_double(F.col(c), F.lit(float(p))).alias("value"))
        for c in LATENCIES for p in probabilities]))
    return merged.select(cells.alias("_cell")).select("_cell.*")
