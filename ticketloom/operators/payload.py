"""Chunk text and payload of a ticket's vector point."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.functions import text as tx


def chunk_text(airline: Column, text: Column) -> Column:
    """'[airline] text', both stripped; a missing airline reads Unknown."""
    return F.format_string(
        "[%s] %s",
        tx.strip(F.coalesce(airline.cast("string"), F.lit("Unknown"))),
        tx.strip(F.coalesce(text.cast("string"), F.lit(""))),
    )


def with_chunks(labeled: DataFrame) -> DataFrame:
    airline = F.col("airline") if "airline" in labeled.columns else F.lit(None)
    return labeled.withColumn("chunk_text", chunk_text(airline, F.col("text")))


# Payload fields in stored order: source column, type, default for a missing value.
FIELDS = (
    ("tweet_id", "tweet_id", "bigint", None),
    ("customer_id", "customer_id", "bigint", None),
    ("airline", "airline", "string", "Unknown"),
    ("created_at", "created_at", "string", ""),
    ("original_text", "original_text", "string", ""),
    ("agent_response", "agent_response", "string", ""),
    ("chunk_text", "chunk_text", "string", ""),
    ("priority", "priority", "string", "NORMAL"),
    ("priority_score", "score", "double", 0.0),
    ("has_urgency_keywords", "has_urgency_keywords", "boolean", None),
    ("has_critical_signal", "has_critical_signal", "boolean", None),
    ("has_delay", "has_delay", "boolean", None),
    ("has_profanity", "has_profanity", "boolean", None),
    ("caps_ratio", "caps_ratio", "double", None),
    ("exclamation_count", "exclamation_count", "int", None),
)


def value_or(df: DataFrame, source: str, type_name: str, default) -> Column:
    """A cast that turns unreadable, missing or absent values into the default."""
    if source not in df.columns:
        return F.lit(default).cast(type_name)
    value = F.col(source)
    if type_name == "bigint":
        value = tx.to_long(value)
    elif type_name == "string":
        value = value.cast("string")
    else:
        value = value.try_cast(type_name)
    return value if default is None else F.coalesce(value, F.lit(default))


def payload_column(df: DataFrame) -> Column:
    return F.struct(*[
        value_or(df, source, type_name, default).alias(name)
        for name, source, type_name, default in FIELDS
    ])
