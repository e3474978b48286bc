"""Declared table shapes. Nothing is inferred from data."""

from pyspark.sql import DataFrame
from pyspark.sql import types as T

RAW = T.StructType([
    T.StructField("tweet_id", T.LongType()),
    T.StructField("author_id", T.StringType()),
    T.StructField("inbound", T.BooleanType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("in_response_to_tweet_id", T.LongType()),
])

QUERY_LOG = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("retrieved_count", T.LongType()),
    T.StructField("low_similarity", T.BooleanType()),
    T.StructField("rag_latency_ms", T.DoubleType()),
    T.StructField("rag_cost_usd", T.DoubleType()),
    T.StructField("non_rag_latency_ms", T.DoubleType()),
    T.StructField("non_rag_cost_usd", T.DoubleType()),
    T.StructField("ml_label", T.StringType()),
    T.StructField("ml_confidence", T.DoubleType()),
    T.StructField("llm_label", T.StringType()),
    T.StructField("llm_latency_ms", T.DoubleType()),
    T.StructField("llm_cost_usd", T.DoubleType()),
])


def require_columns(df: DataFrame, names, table: str = "table") -> DataFrame:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns in {table}: {missing}")
    return df
