"""Agent replies: qualified reply lines, the joined text per ticket, coverage.

A reply's parent id can be hot. Counts and presence are combined before the shuffle and never
gather texts. Texts are first gathered into ordered parts of bounded size, spread over all tasks;
the joined text of a parent is put together from its parts.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom import fixed_values as fv
from ticketloom.functions import text as tx
from ticketloom.operators.ranking import running_total
from ticketloom.operators.routing import outbound_rows
from ticketloom.sources.tables import staged

PART_CHARS = 1 << 20


def reply_candidates(raw: DataFrame) -> DataFrame:
    """Agent messages with a readable parent: parent_id, reply_id and the raw text.

    Taken from the full raw table, so no reply is lost to a ticket filter.
    """
    return (
        outbound_rows(raw)
        .select(
            tx.long_column(raw, "in_response_to_tweet_id").alias("parent_id"),
            tx.long_column(raw, "tweet_id").alias("reply_id"),
            "text",
        )
        # cleaning only shortens: texts that are short already need no cleaning to be dropped
        .filter(F.col("parent_id").isNotNull() & (F.length("text") >= fv.MIN_REPLY_CHARS))
    )


def reply_lines(candidates: DataFrame) -> DataFrame:
    """Qualified replies with cleaned text: parent_id, reply_id, reply."""
    cleaned = F.explode(F.array(tx.clean_text(F.col("text")))).alias("reply")
    lines = candidates.select("parent_id", "reply_id", cleaned)
    return lines.filter(F.length("reply") >= fv.MIN_REPLY_CHARS)


def reply_parts(raw: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """The joined text of every parent as ordered parts: parent_id, part_no, replies, part.

    Each reply's part follows from the characters that precede it, found by a running total
    that is cut into key ranges; a part gathers little more than `part_chars` characters.
    Joining a parent's parts with the reply separator gives its whole text.
    """
    gap = len(fv.REPLY_SEPARATOR)
    # the running total reads its input several times: clean the texts once
    lines = staged(reply_lines(reply_candidates(raw)), "reply-lines")
    sized = lines.withColumn("_chars", F.length("reply").cast("long") + gap)
    placed = running_total(sized, key="reply_id", weight="_chars", by=("parent_id",),
                           out="_through", tie=("reply",))
    numbered = placed.withColumn(
        "part_no", F.floor((F.col("_through") - F.col("_chars")) / F.lit(part_chars))
    )
    texts = F.transform(
        F.array_sort(F.collect_list(F.struct("reply_id", "reply"))), lambda r: r["reply"]
    )
    return numbered.groupBy("parent_id", "part_no").agg(
        F.count("*").alias("replies"), F.array_join(texts, fv.REPLY_SEPARATOR).alias("part")
    )


def joined_parts(parts: DataFrame) -> DataFrame:
    """One row per parent: its replies in key order, joined from the ordered parts.

    Every parent is joined, whatever its size; a text beyond what one cell can hold (2 GB) fails the
    job instead of being dropped.
    """
    ordered = F.array_sort(F.collect_list(F.struct("part_no", "part")))
    texts = F.transform(ordered, lambda p: p["part"])
    return parts.groupBy("parent_id").agg(
        F.array_join(texts, fv.REPLY_SEPARATOR).alias("agent_response")
    )


def joined_replies(raw: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """One row per parent with the joined text of all its replies."""
    return joined_parts(reply_parts(raw, part_chars))


def attach_parts(tickets: DataFrame, parts: DataFrame) -> DataFrame:
    """Left-join the joined replies; '' without a reply. Both sides hold one row per key."""
    joined = joined_parts(parts).withColumnRenamed("parent_id", "tweet_id")
    return tickets.join(joined, "tweet_id", "left").withColumn(
        "agent_response", F.coalesce("agent_response", F.lit(""))
    )


def attach_replies(tickets: DataFrame, raw: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """Tickets with the joined text of all their replies in `raw`."""
    return attach_parts(tickets, reply_parts(raw, part_chars))


def with_answered(tickets: DataFrame, raw: DataFrame) -> DataFrame:
    """Tickets with `answered`: whether `raw` holds a qualified reply.

    Parents are made distinct before the shuffle and no text is gathered.
    """
    parents = (
        reply_lines(reply_candidates(raw))
        .select(F.col("parent_id").alias("tweet_id"), F.lit(True).alias("answered"))
        .distinct()
    )
    return tickets.join(parents, "tweet_id", "left").withColumn(
        "answered", F.coalesce("answered", F.lit(False)))


def reply_coverage(tickets: DataFrame, raw: DataFrame) -> DataFrame:
    """One row: tickets, tickets with a reply, and their share; 0 for an empty table."""
    counts = with_answered(tickets.select("tweet_id"), raw).agg(
        F.count("*").alias("final_count"), F.count_if("answered").alias("with_agent_response")
    )
    share = F.when(
        F.col("final_count") > 0, 100.0 * F.col("with_agent_response") / F.col("final_count")
    ).otherwise(0.0)
    return counts.withColumn("agent_response_pct", F.round(share, 1))
