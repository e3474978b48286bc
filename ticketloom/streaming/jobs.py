"""Streaming jobs over the batch expressions."""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ticketloom import fixed_values as fv
from ticketloom.functions.features import add_features
from ticketloom.functions.rules import label_table
from ticketloom.operators.cleaning import (
    drop_empty, drop_low_quality, ticket_columns, with_clean_text,
)
from ticketloom.operators.routing import route_to_brands
from ticketloom.operators.similarity import top_k
from ticketloom.plans.training import score_texts
from ticketloom.session import scratch_path
from ticketloom.sources import files, models
from ticketloom.sources.audit_log import stamped
from ticketloom.sources.tables import path_exists, staged


def message_stream(spark: SparkSession, path: str, schema, format: str = "parquet",
                   files_per_batch: int | None = None, glob: str | None = None) -> DataFrame:
    """A file stream with a declared schema."""
    reader = spark.readStream.schema(schema).format(format)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def tidy_stream(messages: DataFrame, brands: Sequence[str] = fv.BRANDS,
                extra: Sequence[str] = ()) -> DataFrame:
    """Route and clean messages; no state, so duplicates stay."""
    cleaned = with_clean_text(route_to_brands(messages, brands))
    tickets = ticket_columns(cleaned) if not extra else cleaned
    return drop_low_quality(drop_empty(tickets))


def triage_stream(messages: DataFrame, model=None,
                  brands: Sequence[str] = fv.BRANDS) -> DataFrame:
    """Clean, label, featurise and score each message as it arrives."""
    labeled = label_table(tidy_stream(messages, brands))
    if model is None:
        return add_features(labeled.withColumnsRenamed(
            {"has_delay": "rule_has_delay", "caps_ratio": "rule_caps_ratio",
             "exclamation_count": "rule_exclamation_count",
             "question_count": "rule_question_count"}))
    return score_texts(model, labeled)


def deduplicated_stream(tickets: DataFrame, event_time: str, delay: str,
                        key: str = "tweet_id", salts: int = 16) -> DataFrame:
    """First ticket per text within the delay, by arrival.

    A copy that arrives later than `delay` after the first passes again; a delay longer than the
    data's span keeps exactly one row per text. Streaming state has no combine step, so a very
    frequent text is thinned in `salts` partitions first; each lets one copy through. State grows
    with the distinct texts of one delay: use the RocksDB state store for long delays.
    """
    salted = tickets.withWatermark(event_time, delay).withColumn(
        "_salt", F.pmod(F.xxhash64(key), F.lit(salts))
    )
    thinned = salted.dropDuplicatesWithinWatermark(["text", "_salt"])
    return thinned.drop("_salt").dropDuplicatesWithinWatermark(["text"])


def windowed_counts(labeled: DataFrame, event_time: str, width: str = "1 hour",
                    delay: str | None = None) -> DataFrame:
    """Tickets per brand and priority in tumbling windows; counts combine before the shuffle.

    Without a delay use update mode; state then never ends. In append mode, windows behind the
    watermark are emitted and those still open at the end of the input are not.
    """
    timed = labeled.withWatermark(event_time, delay) if delay else labeled
    return (
        timed.groupBy(F.window(event_time, width), "airline", "priority")
        .agg(F.count("*").alias("tickets"))
        .select(F.col("window.start").alias("window_start"), "airline", "priority", "tickets")
    )


def with_event_time(df: DataFrame, source: Column | str, out: str = "event_time") -> DataFrame:
    """Event time as a zoned timestamp, which watermarks require."""
    value = F.col(source) if isinstance(source, str) else source
    return df.withColumn(out, value.cast("timestamp"))


def start_files(stream: DataFrame, path: str, checkpoint: str, format: str = "parquet",
                available_now: bool = True) -> StreamingQuery:
    """Append a stream to files; the checkpoint makes each row appear once."""
    writer = stream.writeStream.format(format).outputMode("append").option(
        "checkpointLocation", checkpoint
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start(path)


def start_audit(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append audit records as stamped JSON lines."""
    return start_files(stamped(records), path, checkpoint, "json")


def start_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str,
                  mode: str = "append") -> StreamingQuery:
    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(handle)
        .trigger(availableNow=True)
        .start()
    )


WINDOW_KEYS = ("window_start", "airline", "priority")


def start_table(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep a table equal to the running windows: update mode, merged into the days it touches.

    A micro-batch carries only the windows that changed. Their days are read, the changed windows
    replaced, and those day folders overwritten; other days stay as they are. A repeated batch
    writes the same rows again. With a watermark on `counts`, state ends with the delay.
    """
    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        changed = staged(batch.withColumn("day", F.to_date("window_start")), "changed")
        if path_exists(spark, path):
            old = spark.read.schema(changed.schema).parquet(path)
            old = old.join(changed.select("day").distinct(), "day", "left_semi")
            kept = old.join(changed.select(*WINDOW_KEYS), list(WINDOW_KEYS), "left_anti")
            changed = staged(kept.select(*changed.columns).unionByName(changed), "merged")
        changed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "day").parquet(path)

    return start_batches(counts, merge, checkpoint, "update")


def start_retrieval(queries: DataFrame, vectors: DataFrame, path: str, checkpoint: str,
                    dim: int, k: int = fv.TOP_K, floor: float = fv.SIMILARITY_FLOOR,
                    **columns) -> StreamingQuery:
    """Top-k of each micro-batch of query vectors against the static vector table.

    Every batch owns one folder and overwrites it, so a repeated batch leaves no double rows.
    """
    def search(batch: DataFrame, number: int) -> None:
        hits = top_k(batch, vectors, dim, k, floor, **columns)
        hits.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return start_batches(queries, search, checkpoint)


def start_scored(messages: DataFrame, models_path: str, path: str, checkpoint: str,
                 brands: Sequence[str] = fv.BRANDS) -> StreamingQuery:
    """Triage each micro-batch with the model version that is current when it begins; rows carry its number.

    A batch's version is committed before it is scored, so a repeated batch, as after a crash, takes the same
    one and overwrites its own folder. A version published meanwhile serves from the next batch on; before
    the first one rows are UNAVAILABLE with version 0.
    """
    loaded: dict[int, tuple] = {}

    def score(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        mark = f"{path}-versions/{number:012d}.json"
        if not path_exists(spark, mark):
            known = models.versions(spark, models_path)
            files.commit_json(spark, mark, known[-1] if known else 0)
        version = files.read_json(spark, mark)
        if version and version not in loaded:
            loaded.clear()
            loaded[version] = models.load_version(spark, models_path, version)
        model, features = loaded.get(version, (None, ()))
        scored = score_texts(model, label_table(tidy_stream(batch, brands)),
                             features=features or fv.FEATURES)
        scored.withColumn("model_version", F.lit(version)).write.mode("overwrite").parquet(
            f"{path}/batch={number}")

    return start_batches(messages, score, checkpoint)


def finish(query: StreamingQuery, seconds: int | None = None) -> None:
    """Wait for a bounded run, as long as it takes unless `seconds` is given; fail when it fails."""
    if seconds is None:
        query.awaitTermination()
    elif not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError(f"stream did not finish in {seconds} s")


def run_to_files(stream: DataFrame, label: str, format: str = "parquet") -> DataFrame:
    """Run a stream over the files present now and read the result back."""
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    finish(start_files(stream, path, f"{path}-checkpoint", format))
    return spark.read.format(format).schema(stream.schema).load(path)
