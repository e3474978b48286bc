"""Append-only audit log: one JSON line per answered query."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.schemas import QUERY_LOG


def stamped(records: DataFrame) -> DataFrame:
    """Records in the log's column order, stamped with the current time in UTC."""
    moment = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    stamp = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    filled = records.withColumn("timestamp", stamp)
    return filled.select(*[F.col(f.name).cast(f.dataType) for f in QUERY_LOG.fields])


def append_log(records: DataFrame, path: str) -> None:
    # nulls are written out, so every line carries every field
    stamped(records).write.mode("append").option("ignoreNullFields", False).json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUERY_LOG).json(path)
