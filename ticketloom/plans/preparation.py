"""Batch preparation: raw messages to clean, labelled and feature tables and a stats document."""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom import fixed_values as fv
from ticketloom.functions.features import feature_table
from ticketloom.functions.rules import TRIAGE_RULES, RuleSet, label_table
from ticketloom.operators.cleaning import cleaning_counts, tidy_tickets
from ticketloom.operators.profiling import percent, with_one_row
from ticketloom.operators.replies import attach_parts, attach_replies, reply_parts
from ticketloom.operators.routing import other_handles
from ticketloom.sources.tables import write_document, write_table


@dataclass
class Prepared:
    cleaned: DataFrame
    labeled: DataFrame
    features: DataFrame
    stats: DataFrame


def clean_tickets(raw: DataFrame, brands: Sequence[str] = fv.BRANDS) -> DataFrame:
    """The clean ticket table: deduplicated before the reply join, replies from all of raw."""
    return attach_replies(tidy_tickets(raw, brands), raw)


def coverage_of(cleaned: DataFrame) -> DataFrame:
    """Reply coverage read off a clean table."""
    answered = F.length("agent_response") > 0
    counts = cleaned.agg(F.count_if(answered).alias("with_agent_response"),
                         F.count("*").alias("_n"))
    return counts.select(
        "with_agent_response",
        F.round(percent(F.col("with_agent_response"), F.col("_n")), 1).alias("agent_response_pct"),
    )


def stats_document(counts: DataFrame, coverage: DataFrame, handles: DataFrame,
                   labeled: DataFrame) -> DataFrame:
    """One row: funnel, coverage, busiest other handles (at most 25), label counts, run time."""
    urgent = F.count_if(F.col("priority") == "URGENT")
    labels = labeled.agg(urgent.alias("urgent"),
                         F.count_if(F.col("priority") == "NORMAL").alias("normal"),
                         F.count("*").alias("_n"))
    labeling = labels.select(F.struct(
        "urgent", "normal",
        F.round(percent(F.col("urgent"), F.col("_n")), 1).alias("urgent_pct"),
    ).alias("labeling"))
    # Ordered by falling count, then handle: the list was cut to its limit before.
    ordered = F.array_sort(F.collect_list(
        F.struct((-F.col("count")).alias("order"), "handle", "count")
    ))
    listed = handles.agg(F.transform(
        ordered, lambda h: F.struct(h["handle"].alias("handle"), h["count"].alias("count"))
    ).alias("other_top_handles"))
    wide = with_one_row(with_one_row(with_one_row(counts, coverage), listed), labeling)
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()),
                          "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    return wide.withColumn("pipeline_run_at", stamp)


def prepare(raw: DataFrame, out: str, brands: Sequence[str] = fv.BRANDS,
            rules: RuleSet = TRIAGE_RULES) -> Prepared:
    """Run every stage once. Each stage is written and the next one starts from its files."""
    raw = write_table(raw, f"{out}/raw")  # a CSV is parsed once
    parts = write_table(reply_parts(raw), f"{out}/reply_parts")
    cleaned = write_table(attach_parts(tidy_tickets(raw, brands), parts), f"{out}/cleaned")
    labeled = write_table(label_table(cleaned, "text", rules), f"{out}/labeled")
    features = write_table(feature_table(labeled), f"{out}/features")
    stats = stats_document(
        cleaning_counts(raw, brands), coverage_of(cleaned), other_handles(raw, brands), labeled
    )
    write_document(stats, f"{out}/stats")
    return Prepared(cleaned, labeled, features, raw.sparkSession.read.json(f"{out}/stats"))
