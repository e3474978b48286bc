"""Queries over derived messages: sources, routing, cleaning, replies, labels, features."""

from pyspark.sql import functions as F

from ticketloom import fixed_values as fv
from ticketloom.catalog import sql
from ticketloom.catalog.recipes import conversation_messages, raw_messages, table
from ticketloom.functions import text as tx
from ticketloom.functions.features import add_features, feature_table, fill_missing_features
from ticketloom.functions.rules import label_table
from ticketloom.operators import cleaning as cl
from ticketloom.operators import replies as rp
from ticketloom.operators import routing as ro
from ticketloom.operators.payload import payload_column, with_chunks
from ticketloom.operators.ranking import dense_ids, first_rows, seeded_sample
from ticketloom.plans import preparation as prep
from ticketloom.session import scratch_path
from ticketloom.sources.raw import read_raw_csv
from ticketloom.sources.tables import (
    read_document, read_table, staged, write_document, write_table,
)

SHORT = ("tweet_id", "airline", "text")


def short_tickets(spark, sf_dir, keep=SHORT):
    return cl.tidy_tickets(raw_messages(spark, sf_dir), keep=keep)


def labeled_tickets(spark, sf_dir, keep=SHORT):
    return label_table(short_tickets(spark, sf_dir, keep))


def features_of_tickets(spark, sf_dir):
    return feature_table(labeled_tickets(spark, sf_dir, (*SHORT, "created_at")))


def csv_round_trip(spark, sf_dir):
    """Messages written as CSV and read back through the typed reader."""
    path = scratch_path(spark, "messages-csv")
    raw = raw_messages(spark, sf_dir).drop("created_at").withColumn("created_at", F.lit("x"))
    write_table(raw, path, "csv")
    return read_raw_csv(spark, path).drop("created_at")


def stage_tables(spark, sf_dir):
    """Labelled rows written, checked and read back, first 50 by key."""
    path = scratch_path(spark, "labeled")
    write_table(labeled_tickets(spark, sf_dir), path)
    rows = read_table(spark, path, columns=("tweet_id", "priority"), limit=50)
    return rows.select("tweet_id", "priority", "score")


def stage_table_rows(spark, sf_dir):
    """The whole labelled table written, checked and read back."""
    path = scratch_path(spark, "labeled-whole")
    write_table(labeled_tickets(spark, sf_dir), path)
    return read_table(spark, path, columns=("tweet_id", "priority")).select(
        "tweet_id", "airline", "text", "score", "priority")


def stats_document(spark, sf_dir):
    """The stats document written as JSON, read back and flattened."""
    raw = raw_messages(spark, sf_dir)
    labeled = staged(label_table(prep.clean_tickets(raw)), "labeled")
    document = prep.stats_document(
        cl.cleaning_counts(raw), prep.coverage_of(labeled), ro.other_handles(raw, min_count=20),
        labeled,
    )
    path = scratch_path(spark, "stats")
    write_document(document, path)
    return read_document(spark, path).select(
        "raw_total", "raw_inbound_count", "after_airline_filter", "removed_empty",
        "removed_low_quality", "removed_duplicates", "final_count", "with_agent_response",
        F.col("labeling.urgent").alias("urgent"), F.col("labeling.normal").alias("normal"),
        F.array_join(F.transform("other_top_handles", lambda h: h["handle"]), ",").alias("handles"),
    )


def direction_rows(spark, sf_dir):
    raw = raw_messages(spark, sf_dir)
    either = ro.inbound_rows(raw).select("tweet_id", F.lit("inbound").alias("direction"))
    return either.unionByName(
        ro.outbound_rows(raw).select("tweet_id", F.lit("outbound").alias("direction"))
    )


def routed(spark, sf_dir):
    return ro.route_to_brands(raw_messages(spark, sf_dir)).select(
        "tweet_id", "airline", F.lower("airline").alias("airline_key")
    )


def routed_by_table(spark, sf_dir):
    """The same routing with the brand list as a table."""
    brands = table(spark, sf_dir, "events").select(
        F.element_at(F.array(*[F.lit(b) for b in fv.BRANDS]),
                     (F.col("event_id") % len(fv.BRANDS) + 1).cast("int")).alias("brand")
    )
    return ro.route_to_brands(raw_messages(spark, sf_dir), brands).select("tweet_id", "airline")


def routed_counts(spark, sf_dir):
    return ro.brand_counts(ro.route_to_brands(raw_messages(spark, sf_dir)))


def clean_texts(spark, sf_dir):
    cleaned = cl.with_clean_text(raw_messages(spark, sf_dir))
    return cleaned.select("tweet_id", "original_text", "text")


def clean_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.clean_text(F.col("html")).alias("text"))


def junk_filter(spark, sf_dir):
    """Every routed ticket with what the quality filters say."""
    cleaned = cl.with_clean_text(ro.route_to_brands(raw_messages(spark, sf_dir)))
    return cleaned.select(
        "tweet_id", (F.length("text") == 0).alias("is_empty"),
        cl.is_bare_phrase(F.col("text")).alias("is_bare"),
        cl.is_substantial(F.col("text")).alias("is_kept"),
    )


def dedup_first(spark, sf_dir):
    return short_tickets(spark, sf_dir)


def document_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return cl.first_per_text(docs, "doc_id").select("doc_id", "lang")


def duplicates_removed(spark, sf_dir):
    return cl.duplicate_texts_removed(table(spark, sf_dir, "documents"))


def funnel(spark, sf_dir):
    return cl.with_retention(cl.cleaning_counts(raw_messages(spark, sf_dir)))


def reply_lines(spark, sf_dir):
    return rp.reply_lines(rp.reply_candidates(raw_messages(spark, sf_dir)))


def reply_concat(spark, sf_dir):
    return rp.joined_replies(raw_messages(spark, sf_dir))


def reply_parts(spark, sf_dir):
    """Replies joined in parts of 40 characters; the parts follow the characters before them."""
    return rp.reply_parts(raw_messages(spark, sf_dir), part_chars=40)


def conversation_replies(spark, sf_dir):
    """The reply join over real prose: each user turn with the assistant's answer."""
    raw = conversation_messages(spark, sf_dir)
    asked = ro.inbound_rows(raw).select("tweet_id", tx.clean_text(F.col("text")).alias("text"))
    return rp.attach_replies(asked, raw)


def reply_join(spark, sf_dir):
    return prep.clean_tickets(raw_messages(spark, sf_dir))


def coverage(spark, sf_dir):
    raw = raw_messages(spark, sf_dir)
    return rp.reply_coverage(cl.tidy_tickets(raw, keep=("tweet_id", "text")), raw)


def rule_flags(spark, sf_dir):
    return labeled_tickets(spark, sf_dir, ("tweet_id", "text")).drop("text", "priority", "score")


def score(spark, sf_dir):
    return labeled_tickets(spark, sf_dir).select("tweet_id", "airline", "score", "priority")


def raw_labels(spark, sf_dir):
    """The rules over uncleaned text, blanks and nulls included."""
    labeled = label_table(raw_messages(spark, sf_dir).select("tweet_id", "text"))
    return labeled.select("tweet_id", "score", "priority")


def brand_priorities(spark, sf_dir):
    raw = raw_messages(spark, sf_dir)
    labeled = label_table(cl.tidy_tickets(raw, keep=SHORT))
    return rp.with_answered(labeled, raw).groupBy("airline", "priority").agg(
        F.count("*").alias("tickets"), F.count_if("answered").alias("answered"),
        F.sum("score").alias("total_score"),
    )


def features(spark, sf_dir):
    return features_of_tickets(spark, sf_dir)


def document_features(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return add_features(docs).drop("text")


def filled_features(spark, sf_dir):
    """Features of the raw messages with gaps, filled with 0."""
    raw = raw_messages(spark, sf_dir).select("tweet_id", "inbound", "text")
    gaps = add_features(raw).withColumn("word_count", F.when(F.col("inbound"), F.col("word_count")))
    return fill_missing_features(gaps).drop("inbound", "text")


def payloads(spark, sf_dir):
    labeled = label_table(prep.clean_tickets(raw_messages(spark, sf_dir)))
    chunked = with_chunks(labeled)
    return chunked.select(payload_column(chunked).alias("p")).select("p.*").drop("created_at")


def dense_numbers(spark, sf_dir):
    tickets = staged(short_tickets(spark, sf_dir, ("tweet_id", "text")), "tickets")
    return dense_ids(tickets, "tweet_id").select("point_id", "tweet_id")


def sampled_rows(spark, sf_dir):
    """Five critical tickets in seeded order."""
    labeled = labeled_tickets(spark, sf_dir)
    critical = labeled.filter(F.col("score") >= 8)
    return seeded_sample(critical, "tweet_id", 5).select("tweet_id", "score", "text")


def head_rows(spark, sf_dir):
    return first_rows(raw_messages(spark, sf_dir), "tweet_id", 5).select("tweet_id", "text")


QUERIES = {f.__name__: f for f in (
    csv_round_trip, stage_tables, stage_table_rows, stats_document, direction_rows, routed, routed_by_table,
    routed_counts, clean_texts, clean_pages, junk_filter, dedup_first, document_dedup,
    duplicates_removed, funnel, reply_lines, reply_concat, reply_parts, conversation_replies,
    reply_join, coverage, rule_flags, score, raw_labels, brand_priorities, features,
    document_features, filled_features, payloads, dense_numbers, sampled_rows, head_rows,
)}

FUNNEL_SQL = f"""with {sql.CLEANED},
c as (select (select count(*) from raw) as raw_total,
  (select count(*) from raw where inbound) as raw_inbound_count,
  (select count(*) from routed) as after_airline_filter,
  (select count(*) from cleaned where text = '') as removed_empty,
  (select count(*) from cleaned where text <> '') - (select count(*) from kept)
    as removed_low_quality,
  (select count(*) from kept) - (select count(*) from firsts) as removed_duplicates,
  (select count(*) from firsts) as final_count)"""

PART_GAP = len(fv.REPLY_SEPARATOR)

ORACLES = {
    "csv_round_trip": f"""with {sql.MESSAGES_SQL}
        select tweet_id, author_id, inbound, nullif(text, '') as text, in_response_to_tweet_id
        from raw""",
    "stage_tables": f"""with {sql.LABELED_ONLY}
        select tweet_id, priority, score from labeled order by tweet_id limit 50""",
    "stage_table_rows": f"""with {sql.LABELED_ONLY}
        select tweet_id, airline, text, score, priority from labeled""",
    "stats_document": f"""{FUNNEL_SQL},
        {sql.REPLIES}, {sql.labeled_from('firsts')},
        handles as (select airline as handle, count(*) as n from inbound_rows
          where airline is not null and lower(airline) not in ({sql.BRANDS})
          group by airline having count(*) >= 20 order by n desc, handle limit 25)
        select c.*,
          (select count(*) from firsts f where exists
            (select 1 from joined j where j.parent_id = f.tweet_id)) as with_agent_response,
          (select count(*) from labeled where priority = 'URGENT') as urgent,
          (select count(*) from labeled where priority = 'NORMAL') as normal,
          (select coalesce(string_agg(handle, ',' order by n desc, handle), '') from handles)
            as handles
        from c""",
    "direction_rows": f"""with {sql.MESSAGES_SQL}
        select tweet_id, case when inbound then 'inbound' else 'outbound' end as direction
        from raw""",
    "routed": f"""with {sql.ROUTED}
        select tweet_id, airline, lower(airline) as airline_key from routed""",
    "routed_by_table": f"with {sql.ROUTED} select tweet_id, airline from routed",
    "routed_counts": f"""with {sql.ROUTED}
        select airline, count(*) as tickets,
          100e0 * count(*) / (select count(*) from routed) as share_pct
        from routed group by airline""",
    "clean_texts": f"""with {sql.MESSAGES_SQL}
        select tweet_id, text as original_text, {sql.clean('text')} as text from raw""",
    "clean_pages": f"select page_id, {sql.clean('html')} as text from pages",
    "junk_filter": f"""with {sql.CLEANED}
        select tweet_id, text = '' as is_empty,
          lower(text) in ('dm sent', 'thanks', 'thank you', 'help') as is_bare,
          length(text) >= 8 and lower(text) not in ('dm sent', 'thanks', 'thank you', 'help')
            as is_kept
        from cleaned""",
    "dedup_first": f"with {sql.CLEANED} select tweet_id, airline, text from firsts",
    "document_dedup": """select doc_id, lang from (select doc_id, lang,
          row_number() over (partition by text order by doc_id) as nth from documents)
        where nth = 1""",
    "duplicates_removed": """select count(*) as rows, count(distinct text) as distinct_texts,
          count(*) - count(distinct text) as removed from documents""",
    "funnel": f"""{FUNNEL_SQL}
        select *, removed_empty + removed_low_quality + removed_duplicates as removed_total,
          100e0 * final_count / raw_total as retention_pct from c""",
    "reply_lines": f"with {sql.MESSAGES_SQL}, {sql.REPLIES} select * from replies",
    "reply_concat": f"""with {sql.MESSAGES_SQL}, {sql.REPLIES}
        select parent_id, response as agent_response from joined""",
    "reply_parts": f"""with {sql.MESSAGES_SQL}, {sql.REPLIES},
        sized as (select *, coalesce(sum(length(reply) + {PART_GAP}) over (
            partition by parent_id order by reply_id
            rows between unbounded preceding and 1 preceding), 0) as before from replies)
        select parent_id, cast(floor(before / 40) as bigint) as part_no, count(*) as replies,
          string_agg(reply, '{fv.REPLY_SEPARATOR}' order by reply_id) as part
        from sized group by all""",
    "conversation_replies": f"""with turns as (
          select conv_id * 1000 + turn as id, role, {sql.clean('text')} as text
          from conversations),
        answers as (select id - 1 as parent_id, id, text from turns
          where role = 'assistant' and length(text) >= 10)
        select u.id as tweet_id, u.text as text,
          coalesce(string_agg(a.text, ' | ' order by a.id), '') as agent_response
        from turns u left join answers a on a.parent_id = u.id
        where u.role = 'user' group by u.id, u.text""",
    "reply_join": f"with {sql.TICKETS} select * from tickets",
    "coverage": f"""with {sql.TICKETS}
        select count(*) as final_count, count(*) filter (where agent_response <> '')
          as with_agent_response,
          round(100e0 * count(*) filter (where agent_response <> '') / count(*), 1)
          as agent_response_pct from tickets""",
    "rule_flags": f"""with {sql.LABELED_ONLY}
        select tweet_id, has_critical_signal, has_urgency_keywords, has_delay, has_profanity,
          has_sarcasm, exclamation_count, question_count, caps_ratio from labeled""",
    "score": f"with {sql.LABELED_ONLY} select tweet_id, airline, score, priority from labeled",
    "raw_labels": f"""with {sql.MESSAGES_SQL},
        filled as (select tweet_id, coalesce(text, '') as text from raw),
        {sql.labeled_from('filled')} select tweet_id, score, priority from labeled""",
    "brand_priorities": f"""with {sql.LABELED}
        select airline, priority, count(*) as tickets,
          count(*) filter (where agent_response <> '') as answered,
          cast(sum(score) as bigint) as total_score
        from labeled group by airline, priority""",
    "features": f"with {sql.FEATURED} select * from featured",
    "document_features": f"select doc_id, {sql.features('text')} from documents",
    "filled_features": f"""with {sql.MESSAGES_SQL},
        filled as (select tweet_id, inbound, coalesce(text, '') as text from raw),
        f as (select tweet_id, inbound, {sql.features('text')} from filled)
        select * exclude (inbound)
          replace (case when inbound then word_count else 0 end as word_count) from f""",
    "payloads": f"""with {sql.LABELED}
        select tweet_id, null::bigint as customer_id, airline, original_text, agent_response,
          '[' || airline || '] ' || text as chunk_text, priority,
          score::double as priority_score, has_urgency_keywords, has_critical_signal, has_delay,
          has_profanity, caps_ratio, exclamation_count from labeled""",
    "dense_numbers": f"""with {sql.CLEANED}
        select row_number() over (order by tweet_id) - 1 as point_id, tweet_id from firsts""",
    "sampled_rows": f"""with {sql.LABELED_ONLY}
        select tweet_id, score, text from labeled where score >= 8
        order by md5('42:' || tweet_id), tweet_id limit 5""",
    "head_rows": f"""with {sql.MESSAGES_SQL}
        select tweet_id, text from raw order by tweet_id limit 5""",
}
