"""Stage tables, stats documents and status rows."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.schemas import require_columns
from ticketloom.session import scratch_path


# Quoted newlines, doubled quotes, and blanks kept at both ends of a cell.
CSV = {
    "header": True, "escape": '"', "multiLine": True,
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def write_table(df: DataFrame, path: str, format: str = "parquet") -> DataFrame:
    """Write a stage table and return it as read back, so later stages start from the files."""
    options = CSV if format == "csv" else {}
    df.write.mode("overwrite").format(format).options(**options).save(path)
    return df.sparkSession.read.schema(df.schema).format(format).options(**options).load(path)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate table to the shared scratch folder and continue from its files.

    For compact results that several later steps read: their input is computed once, and a lost
    executor costs a file read instead of a recomputation.
    """
    return write_table(df, scratch_path(df.sparkSession, label))


def read_table(spark: SparkSession, path: str, columns=(), limit: int | None = None,
               key: str = "tweet_id") -> DataFrame:
    """Read a stage table, check its columns, and optionally keep its first rows by key."""
    df = require_columns(spark.read.parquet(path), columns, path)
    return df.orderBy(key).limit(limit) if limit else df


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.exists(hadoop)


def is_folder(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.getFileStatus(hadoop).isDirectory()


def write_document(one_row: DataFrame, path: str) -> None:
    """Write a one-row nested document as JSON."""
    one_row.coalesce(1).write.mode("overwrite").json(path)


def read_document(spark: SparkSession, path: str, status: str = "not_run",
                  message: str = "Run the preparation job first.") -> DataFrame:
    """The document, or a one-row status table when it has not been written."""
    try:
        return spark.read.json(path)
    except AnalysisException as missing:
        if path_exists(spark, path):
            raise missing
        return spark.range(1).select(
            F.lit(status).alias("status"), F.lit(message).alias("message")
        )
