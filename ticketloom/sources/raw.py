"""Raw message sources: CSV exports and Parquet tables."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom import fixed_values as fv
from ticketloom.functions import text as tx
from ticketloom.schemas import RAW, require_columns
from ticketloom.sources.tables import CSV


def typed_raw(df: DataFrame, na_tokens=fv.NA_TOKENS) -> DataFrame:
    """Type an all-text message table by column name; unreadable cells become null."""
    require_columns(df, RAW.fieldNames(), "raw messages")

    def cell(name):
        value = F.col(name)
        return F.when(~value.isin(*na_tokens), value)

    return df.select(
        tx.to_long(cell("tweet_id")).alias("tweet_id"),
        cell("author_id").alias("author_id"),
        cell("inbound").try_cast("boolean").alias("inbound"),
        cell("created_at").alias("created_at"),
        cell("text").alias("text"),
        tx.to_long(cell("in_response_to_tweet_id")).alias("in_response_to_tweet_id"),
    )


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read CSV exports with a header row, quoted newlines and doubled quotes.

    Quoted newlines make one file one task, so give it many files; everything after the first
    stage reads Parquet. A missing path raises when the files are listed.
    """
    text = spark.read.options(**CSV).option("mode", "PERMISSIVE").csv(path)
    return typed_raw(text)


def read_raw_parquet(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    return require_columns(df, RAW.fieldNames(), "raw messages")


def parsed_time(created_at: Column) -> Column:
    """Event time of the corpus's stamp, for example 'Tue Oct 31 22:10:47 +0000 2017'."""
    without_weekday = F.regexp_replace(created_at, r"^[A-Za-z]{3} ", "")
    return F.try_to_timestamp(without_weekday, F.lit("MMM d HH:mm:ss Z yyyy"))
