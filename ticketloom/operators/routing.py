"""Direction and brand routing of raw messages."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketloom import fixed_values as fv
from ticketloom.functions import text as tx

SHORT_LIST = 1_000


def is_inbound() -> Column:
    """True only for rows marked inbound; a missing mark counts as outbound."""
    return F.col("inbound").eqNullSafe(F.lit(True))


def inbound_rows(raw: DataFrame) -> DataFrame:
    return raw.filter(is_inbound())


def outbound_rows(raw: DataFrame) -> DataFrame:
    return raw.filter(~is_inbound())


def with_handle(messages: DataFrame) -> DataFrame:
    return messages.withColumn("airline", tx.leading_handle(F.col("text")))


def is_brand(handle: Column, brands: Sequence[str] = fv.BRANDS) -> Column:
    return F.lower(handle).isin(*[b.lower() for b in brands])


def route_to_brands(raw: DataFrame, brands: Sequence[str] | DataFrame = fv.BRANDS) -> DataFrame:
    """Inbound messages whose leading handle is one of the brands, in any case.

    `airline` keeps the typed case. The direction test comes before the regex. A list longer
    than SHORT_LIST, or a one-column DataFrame of brands, is matched by a semi-join whose
    strategy Spark picks from the size it measures.
    """
    # '' stands for "no handle" here: it is in no list, and comparing it costs no null test
    routed = inbound_rows(raw).withColumn("airline", tx.handle_or_empty(F.col("text")))
    if isinstance(brands, DataFrame):
        names = brands.select(F.lower(F.col(brands.columns[0])).alias("_brand")).distinct()
    elif len(brands) > SHORT_LIST:
        spark = raw.sparkSession
        names = spark.createDataFrame([(b.lower(),) for b in set(brands)], "_brand string")
    else:
        return routed.filter(is_brand(F.col("airline"), brands))
    return (
        routed.withColumn("_key", F.lower("airline"))
        .join(names, F.col("_key") == F.col("_brand"), "left_semi")
        .drop("_key")
    )


def handle_counts(raw: DataFrame) -> DataFrame:
    """Inbound messages per leading handle, as typed."""
    return (
        with_handle(inbound_rows(raw))
        .filter(F.col("airline").isNotNull())
        .groupBy(F.col("airline").alias("handle"))
        .agg(F.count("*").alias("count"))
    )


def other_handles(raw: DataFrame, brands: Sequence[str] = fv.BRANDS,
                  min_count: int = fv.OTHER_HANDLE_MIN_COUNT,
                  limit: int = fv.OTHER_HANDLE_LIMIT) -> DataFrame:
    """The busiest handles outside the brand list."""
    counts = handle_counts(raw).filter(
        ~is_brand(F.col("handle"), brands) & (F.col("count") >= min_count)
    )
    return counts.orderBy(F.desc("count"), "handle").limit(limit)


def first_mentions(raw: DataFrame, brands: Sequence[str] = fv.BRANDS,
                   limit: int = fv.FIRST_MENTION_LIMIT) -> DataFrame:
    """Top handles that are the very first characters, marked when they belong to a brand.

    Unlike routing this does not skip leading white space.
    """
    mention = F.regexp_extract("text", "^" + tx.HANDLE, 1)
    return (
        inbound_rows(raw)
        .select(mention.alias("handle"))
        .filter(F.col("handle") != "")
        .groupBy("handle")
        .agg(F.count("*").alias("count"))
        .withColumn("is_target", is_brand(F.col("handle"), brands))
        .orderBy(F.desc("count"), "handle")
        .limit(limit)
    )


def brand_counts(routed: DataFrame) -> DataFrame:
    """Tickets per brand handle as typed, with each one's share in percent.

    The share divides by a window over the grouped rows: one row per handle, not per ticket.
    """
    counts = routed.groupBy("airline").agg(F.count("*").alias("tickets"))
    everything = Window.partitionBy(F.lit(1))
    whole = F.sum("tickets").over(everything)
    return counts.withColumn("share_pct", 100.0 * F.col("tickets") / whole)
