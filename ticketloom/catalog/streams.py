"""Streaming queries over the shared events file, each run to the end of its input."""

from pyspark.sql import functions as F

from ticketloom.catalog import comparisons, sql, vectors
from ticketloom.catalog.recipes import messages_from, table
from ticketloom.functions.rules import label_table
from ticketloom.session import scratch_path
from ticketloom.sources.audit_log import read_log
from ticketloom.sources.tables import is_folder
from ticketloom.streaming import jobs


def table_stream(spark, sf_dir, name):
    """A shared table as a stream, be it one file or a folder of files."""
    schema, path = table(spark, sf_dir, name).schema, f"{sf_dir}/{name}.parquet"
    if is_folder(spark, path):
        return jobs.message_stream(spark, path, schema)
    return jobs.message_stream(spark, sf_dir, schema, glob=f"{name}.parquet")


def event_stream(spark, sf_dir):
    return table_stream(spark, sf_dir, "events")


def message_stream(spark, sf_dir):
    """Derived messages as a stream, with their event time as a zoned timestamp."""
    return messages_from(jobs.with_event_time(event_stream(spark, sf_dir), "ts", "ts"))


def stream_triage(spark, sf_dir):
    triaged = jobs.triage_stream(message_stream(spark, sf_dir))
    rows = jobs.run_to_files(triaged, "triage")
    return rows.select("tweet_id", "text", "score", "priority", "word_count", "has_refund")


def stream_dedup(spark, sf_dir):
    """Deduplicated with a delay longer than the data: one row per text."""
    tickets = jobs.tidy_stream(message_stream(spark, sf_dir))
    unique = jobs.deduplicated_stream(tickets, "created_at", "3650 days")
    return jobs.run_to_files(unique, "unique").select("text")


def stream_audit(spark, sf_dir):
    """Query log records streamed to the audit log."""
    path = scratch_path(spark, "streamed-log")
    records = comparisons.log_records(spark, sf_dir)
    source = scratch_path(spark, "records")
    records.write.parquet(source)
    stream = jobs.message_stream(spark, source, records.schema)
    jobs.finish(jobs.start_audit(stream, path, f"{path}-checkpoint"))
    return read_log(spark, path).drop("timestamp")


def stream_retrieval(spark, sf_dir):
    """Vectors arriving as queries, searched against the stored table."""
    stored = vectors.stored_vectors(spark, sf_dir)
    stream = table_stream(spark, sf_dir, "embeddings")
    path = scratch_path(spark, "streamed-hits")
    jobs.finish(jobs.start_retrieval(
        stream, stored, path, f"{path}-checkpoint", vectors.DIM, query_id="vec_id",
        query_vector="embedding", skip_same_id=True,
    ))
    return spark.read.parquet(path).select(
        "query_id", "rank", "hit_id", F.round("similarity", 4).alias("similarity"))


def stream_counts(spark, sf_dir):
    """Priority counts per brand and hour, kept in a table."""
    labeled = label_table(jobs.tidy_stream(message_stream(spark, sf_dir)))
    path = scratch_path(spark, "windows")
    counts = jobs.windowed_counts(labeled, "created_at", "1 hour", delay="3650 days")
    jobs.finish(jobs.start_table(counts, path, f"{path}-checkpoint"))
    hour = F.date_format("window_start", "yyyy-MM-dd HH").alias("hour")
    return spark.read.parquet(path).select(hour, "airline", "priority", "tickets")


QUERIES = {f.__name__: f for f in (
    stream_triage, stream_dedup, stream_audit, stream_retrieval, stream_counts,
)}

ORACLES = {
    "stream_triage": f"""with {sql.CLEANED}, {sql.labeled_from('kept')},
        f as (select tweet_id, text, score, priority,
          cast(len(regexp_extract_all(text, '\\S+')) as integer) as word_count,
          cast(regexp_matches(lower(text), '\\brefund\\b') as integer) as has_refund
          from labeled) select * from f""",
    "stream_dedup": f"with {sql.CLEANED} select distinct text from kept",
    "stream_audit": comparisons.ORACLES["audit_append"],
    "stream_retrieval": vectors.ORACLES["cosine_topk_blocks"],
    "stream_counts": f"""with {sql.CLEANED}, {sql.labeled_from('kept')}
        select strftime(created_at, '%Y-%m-%d %H') as hour, airline, priority, count(*) as tickets
        from labeled group by all""",
}
