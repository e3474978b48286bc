"""Ticket cleaning: text, quality filters, duplicates, counts of what each step removed."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom import fixed_values as fv
from ticketloom.functions import text as tx
from ticketloom.operators.routing import is_brand, is_inbound, route_to_brands


def is_bare_phrase(text: Column) -> Column:
    return F.lower(text).isin(*fv.BARE_PHRASES)


def is_substantial(text: Column) -> Column:
    """Long enough and more than a bare courtesy."""
    return (F.length(text) >= fv.MIN_TICKET_CHARS) & ~is_bare_phrase(text)


def with_clean_text(messages: DataFrame) -> DataFrame:
    """Keep the original text and replace `text` by its cleaned form.

    The cleaned text comes out of a one-element generator. Filters on it then stay above the
    generator, so the chain of replacements runs once per row; as a plain projection it would
    be copied into every later filter.
    """
    kept = [c for c in messages.columns if c != "text"]
    return messages.select(
        *kept,
        F.col("text").alias("original_text"),
        F.explode(F.array(tx.clean_text(F.col("text")))).alias("text"),
    )


def drop_empty(tickets: DataFrame) -> DataFrame:
    return tickets.filter(F.length("text") > 0)


def drop_low_quality(tickets: DataFrame) -> DataFrame:
    return tickets.filter(is_substantial(F.col("text")))


def drop_null_text(tickets: DataFrame) -> DataFrame:
    return tickets.dropna(subset=["text"])


def first_per_text(tickets: DataFrame, key: str = "tweet_id") -> DataFrame:
    """Keep, for each distinct text, the row with the smallest key.

    A minimum is combined before the shuffle, so however many copies a text has, each map task
    sends one row for it. The 64-bit hash leads the grouping key to make its sort cheap; the text
    itself stays in the key, so equal hashes never merge different texts.
    """
    rest = [c for c in tickets.columns if c not in (key, "text")]
    smallest = F.min(F.struct(key, *rest)).alias("_row")
    return (
        tickets.groupBy(F.xxhash64("text").alias("_hash"), "text")
        .agg(smallest)
        .select(*[F.col("text") if c == "text" else F.col(f"_row.{c}") for c in tickets.columns])
    )


TICKET_COLUMNS = (
    ("tweet_id", "tweet_id"),
    ("author_id", "customer_id"),
    ("airline", "airline"),
    ("created_at", "created_at"),
    ("inbound", "inbound"),
    ("original_text", "original_text"),
    ("text", "text"),
)


def ticket_columns(messages: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """Select and rename the ticket columns; absent optional ones are left out."""
    return messages.select(*[
        F.col(source).alias(name)
        for source, name in TICKET_COLUMNS
        if source in messages.columns and (keep is None or name in keep)
    ])


def tidy_tickets(raw: DataFrame, brands: Sequence[str] | DataFrame = fv.BRANDS,
                 keep: Sequence[str] | None = None) -> DataFrame:
    """Route, clean, filter and deduplicate; everything but the reply join.

    `keep` names the ticket columns the caller needs (at least tweet_id and text). Others are
    then neither read nor shuffled: the optimizer cannot see which parts of a deduplicated row
    go unused.
    """
    tickets = ticket_columns(with_clean_text(route_to_brands(raw, brands)), keep)
    tickets = drop_low_quality(drop_empty(tickets))
    return drop_null_text(first_per_text(tickets))


def cleaning_counts(raw: DataFrame, brands: Sequence[str] = fv.BRANDS) -> DataFrame:
    """One row: how many messages each step kept or removed.

    One scan. Plain counts and the distinct count of surviving texts are one aggregate; copies
    of a text collapse before the shuffle.
    """
    to_brand = F.coalesce(is_brand(tx.handle_or_empty(F.col("text")), brands), F.lit(False))
    marked = raw.select(
        is_inbound().alias("inbound"),
        F.when(is_inbound(), to_brand).otherwise(False).alias("routed"),
        "text",
    )
    cleaned = marked.select(
        "inbound",
        "routed",
        F.explode(F.array(F.when(F.col("routed"), tx.clean_text(F.col("text"))))).alias("text"),
    )
    steps = cleaned.select(
        "inbound",
        "routed",
        (F.col("routed") & (F.length("text") == 0)).alias("empty"),
        F.when(F.col("routed") & is_substantial(F.col("text")), F.col("text")).alias("kept"),
    )
    # Grouping by the kept text first makes every count a sum over distinct texts.
    by_text = steps.groupBy("kept").agg(
        F.count("*").alias("rows"),
        F.count_if("inbound").alias("inbound"),
        F.count_if("routed").alias("routed"),
        F.count_if("empty").alias("empty"),
    )
    totals = by_text.agg(
        F.sum("rows").alias("raw_total"),
        F.sum("inbound").alias("raw_inbound_count"),
        F.sum("routed").alias("after_airline_filter"),
        F.sum("empty").alias("removed_empty"),
        F.sum(F.when(F.col("kept").isNotNull(), F.col("rows")).otherwise(0)).alias("_kept"),
        F.count("kept").alias("final_count"),
    ).na.fill(0)
    return totals.select(
        "raw_total",
        "raw_inbound_count",
        "after_airline_filter",
        "removed_empty",
        (F.col("after_airline_filter") - F.col("removed_empty") - F.col("_kept"))
        .alias("removed_low_quality"),
        (F.col("_kept") - F.col("final_count")).alias("removed_duplicates"),
        "final_count",
    )


def with_retention(counts: DataFrame) -> DataFrame:
    """Add the retention share and the total of quality removals; 0 when nothing came in."""
    return counts.withColumns({
        "removed_total": F.col("removed_empty") + F.col("removed_low_quality")
        + F.col("removed_duplicates"),
        "retention_pct": F.when(
            F.col("raw_total") > 0, 100.0 * F.col("final_count") / F.col("raw_total")
        ).otherwise(0.0),
    })


def duplicate_texts_removed(df: DataFrame, text_column: str = "text") -> DataFrame:
    """How many rows keep-first deduplication on one column removes."""
    copies = df.groupBy(text_column).agg(F.count("*").alias("copies"))
    return copies.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"),
        F.count("*").alias("distinct_texts"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("removed"),
    )
