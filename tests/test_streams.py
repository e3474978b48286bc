"""Streams give the batch result."""

import pytest
from pyspark.sql import functions as F

from ticketloom.catalog import streams as cat
from ticketloom.catalog import vectors
from ticketloom.catalog.recipes import messages_from, raw_messages, table
from ticketloom.functions.rules import label_table
from ticketloom.operators.cleaning import tidy_tickets
from ticketloom.session import scratch_path
from ticketloom.streaming import jobs


@pytest.fixture
def split_events(spark, sf):
    """The events in four files that arrive one per batch, in time order."""
    path = scratch_path(spark, "events")
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    for i in range(4):
        part = events.filter((F.col("event_id") / 250).cast("int") == i)
        part.coalesce(1).write.mode("append").parquet(path)
    return path, events.schema


def message_stream(spark, split_events):
    path, schema = split_events
    return messages_from(jobs.message_stream(spark, path, schema, files_per_batch=1))


def test_dedup_over_several_batches_equals_batch(spark, sf, split_events):
    tickets = jobs.tidy_stream(message_stream(spark, split_events))
    rows = jobs.run_to_files(jobs.deduplicated_stream(tickets, "created_at", "3650 days"), "unique")
    batch = tidy_tickets(raw_messages(spark, sf))
    assert sorted(r["text"] for r in rows.collect()) == sorted(r["text"] for r in batch.collect())


def test_short_delay_lets_late_copies_pass(spark, split_events):
    tickets = jobs.tidy_stream(message_stream(spark, split_events))
    rows = jobs.run_to_files(jobs.deduplicated_stream(tickets, "created_at", "10 minutes"), "late")
    texts = [r["text"] for r in rows.collect()]
    assert len(texts) > len(set(texts)) == 368


def test_merged_windows_equal_batch_and_append_emits_the_closed_ones(
        spark, sf, split_events):
    labeled = label_table(jobs.tidy_stream(message_stream(spark, split_events)))
    path = scratch_path(spark, "windows")
    jobs.finish(jobs.start_table(jobs.windowed_counts(labeled, "created_at"), path, path + "-c"))
    key = ("window_start", "airline", "priority", "tickets")

    def rows(df):
        return {tuple(r[k] for k in key) for r in df.collect()}

    complete = rows(spark.read.parquet(path))
    batch = label_table(jobs.tidy_stream(raw_messages(spark, sf).withColumn(
        "created_at", F.col("created_at").cast("timestamp"))))
    assert complete == rows(jobs.windowed_counts(batch, "created_at"))
    closed = rows(jobs.run_to_files(
        jobs.windowed_counts(labeled, "created_at", delay="1 hour"), "closed"))
    assert closed and closed < complete


def test_restart_continues_where_it_stopped(spark, split_events):
    triaged = jobs.triage_stream(message_stream(spark, split_events))
    path = scratch_path(spark, "resumed")
    jobs.finish(jobs.start_files(triaged, path, path + "-c"))
    once = spark.read.parquet(path).count()
    jobs.finish(jobs.start_files(triaged, path, path + "-c"))
    assert once > 0 and spark.read.parquet(path).count() == once


def test_a_stream_that_does_not_end_is_stopped(spark):
    forever = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    path = scratch_path(spark, "forever")
    query = jobs.start_files(forever, path, path + "-c", available_now=False)
    with pytest.raises(TimeoutError):
        jobs.finish(query, 2)
    assert not query.isActive


def test_scored_stream_without_a_model_keeps_both_feature_sets(spark, sf):
    df = jobs.triage_stream(cat.message_stream(spark, sf))
    assert {"rule_has_delay", "has_delay", "rule_caps_ratio", "caps_ratio"} <= set(df.columns)


def test_tables_of_several_files_stream_whole(spark, sf):
    path = scratch_path(spark, "several-files")
    for name in ("events", "embeddings"):
        rows = table(spark, sf, name)
        rows.repartition(3).write.parquet(f"{path}/{name}.parquet")
        assert cat.table_stream(spark, path, name).schema == rows.schema
    order = ["query_id", "rank"]
    assert cat.stream_retrieval(spark, path).orderBy(order).collect() == vectors.cosine_topk(
        spark, sf).orderBy(order).collect()
    assert cat.stream_triage(spark, path).count() == cat.stream_triage(spark, sf).count() > 0
