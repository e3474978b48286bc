"""Jobs that keep state between runs: range-read CSV, streams, completions, daily roll-ups, evidence."""

import pandas as pd
from pyspark.sql import functions as F

from ticketloom import fixed_values as fv
from ticketloom.catalog import comparisons, messages, models, sql, streams, vectors
from ticketloom.catalog.recipes import query_calls, raw_messages
from ticketloom.functions import prompts as pr
from ticketloom.functions.rules import TRIAGE_RULES, label_table
from ticketloom.operators import audit as au
from ticketloom.operators import audit_sketches as sk
from ticketloom.operators import costs as co
from ticketloom.operators import evidence as ev
from ticketloom.plans import answering, completions
from ticketloom.plans.training import score_texts
from ticketloom.session import scratch_path
from ticketloom.sources import models as stored_models
from ticketloom.sources.csv_ranges import read_raw_csv_ranges
from ticketloom.sources.tables import read_document, staged, write_document, write_table
from ticketloom.streaming import first_ever as fe
from ticketloom.streaming import jobs


def csv_ranges(spark, sf_dir):
    """Messages with line breaks and quotes in their cells, written as CSV and read by ranges."""
    path = scratch_path(spark, "messages-csv")
    broken = F.concat(F.lit('say "'), F.col("text"), F.lit('",\nplease'))
    write_table(raw_messages(spark, sf_dir).withColumns({
        "text": broken, "created_at": F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")}), path, "csv")
    return read_raw_csv_ranges(spark, path)


def first_rows(spark, sf_dir):
    tickets = jobs.tidy_stream(streams.message_stream(fe.with_rocksdb(spark), sf_dir))
    rows = fe.first_ever(tickets, "text", "tweet_id", "created_at", delay_days=1)
    path = scratch_path(spark, "first-ever")
    jobs.finish(jobs.start_files(rows, path, f"{path}-checkpoint"))
    return spark.read.schema(rows.schema).parquet(path)


def stream_first_ever(spark, sf_dir):
    """The first ticket of every text ever, from state that does not end with a watermark."""
    return first_rows(spark, sf_dir).filter("row_id is not null").select(
        F.col("row_id").alias("tweet_id"), F.col("key").alias("text"))


def stream_first_ever_counts(spark, sf_dir):
    return first_rows(spark, sf_dir).agg(F.count("row_id").alias("firsts"), F.sum("copies").alias("copies"))


def stream_scored(spark, sf_dir):
    """Streamed rows scored by a published model, against batch scores by the same one."""
    trained = models.trained(spark, sf_dir)
    model = trained.models[trained.best]
    store, path = scratch_path(spark, "models"), scratch_path(spark, "scored")
    stored_models.publish(model, fv.FEATURES, store, spark)
    jobs.finish(jobs.start_scored(streams.message_stream(spark, sf_dir), store, path, f"{path}-checkpoint"))
    batch = score_texts(model, label_table(jobs.tidy_stream(raw_messages(spark, sf_dir)))).select(
        "tweet_id", F.struct("label", "confidence").alias("expected"))
    rows = spark.read.parquet(path).select(
        "tweet_id", F.struct("label", "confidence").alias("found"), "model_version")
    same = F.col("found").eqNullSafe(F.col("expected"))
    return rows.join(batch, "tweet_id", "full_outer").agg(
        F.count("*").alias("rows"), F.count_if(~same).alias("different"),
        F.max("model_version").cast("long").alias("version"))


def scored_responses(spark, sf_dir):
    """Response rows with the classifier's answer, against batch scores of the same queries."""
    trained = models.trained(spark, sf_dir)
    model = trained.models[trained.best]
    stored, encoder = vectors.filled_table(spark, sf_dir)
    accepted = answering.screen(query_calls(spark, sf_dir).select("query_id", "query")).accepted
    answered = answering.respond_all(accepted, stored, encoder, fv.VECTOR_DIM, model).select(
        "query_id", "ml_label", "ml_confidence")
    batch = score_texts(model, accepted, "query").select("query_id", "label", "confidence")
    same = (F.col("ml_label") == F.col("label")) & (F.col("ml_confidence") == F.col("confidence"))
    return answered.join(batch, "query_id", "full_outer").agg(
        F.count("*").alias("responses"), F.count_if(F.col("ml_label") == "UNAVAILABLE").alias("unavailable"),
        F.count_if(~F.coalesce(same, F.lit(False))).alias("different"))


def document_status(spark, sf_dir):
    """A written document and one that no job has written."""
    path = scratch_path(spark, "documents")
    write_document(messages.stats_document(spark, sf_dir), f"{path}/stats")
    there = read_document(spark, f"{path}/stats").select(
        F.lit("stats").alias("document"), F.lit("ready").alias("status"),
        F.lit(None).cast("string").alias("message"), F.col("raw_total").cast("long").alias("raw_total"))
    absent = read_document(spark, f"{path}/metrics").select(
        F.lit("metrics").alias("document"), "status", "message", F.lit(None).cast("long").alias("raw_total"))
    return there.unionByName(absent)


TRIES = 2


def clerk(prompts: pd.Series) -> pd.DataFrame:
    """A stand-in for a completion service: refuses every prompt of a length divisible by ten."""
    refused = prompts.str.len() % 10 == 0
    answer = prompts.str.lower().str.contains("refund").map({True: "URGENT", False: "NORMAL"})
    completion = answer.where(~refused, f"{fv.COMPLETION_ERROR_PREFIX}: refused]")
    return pd.DataFrame({
        "completion": completion,
        "input_tokens": prompts.str.len().where(~refused, 0).astype("int64"),
        "output_tokens": completion.str.len().where(~refused, 0).astype("int64"),
        "provider": pd.Series("primary", index=prompts.index).where(~refused, None),
    })


def asked(spark, sf_dir):
    path = scratch_path(spark, "completions")
    prompts = messages.short_tickets(spark, sf_dir).select(
        "tweet_id", pr.label_prompt(F.col("text")).alias("prompt"))
    completions.complete_all(prompts, clerk, path, waves=4, tries=TRIES)
    return prompts, path


def completed_labels(spark, sf_dir):
    """Every ticket's label prompt completed once, its answer read and paid for."""
    prompts, path = asked(spark, sf_dir)
    found = completions.with_answers(prompts, path)
    return co.with_cost(found).select(
        "tweet_id", F.when(F.col("completion").isNotNull(), pr.parsed_label(F.col("completion"))).alias("label"),
        "cost_usd")


def completion_failures(spark, sf_dir):
    _, path = asked(spark, sf_dir)
    return completions.failures(spark, path, TRIES)


def daily_path(spark, sf_dir):
    """The log of seven days rolled up day by day; the last day comes alone."""
    log = comparisons.log_records(spark, sf_dir, F.expr(
        "date_add(date'2024-01-01', cast(query_id % 7 as int))").alias("day"))
    path = scratch_path(spark, "daily")
    sk.write_days(log.filter("day < date'2024-01-07'"), path)
    sk.write_days(log.filter("day = date'2024-01-07'"), path)
    return path


def daily_rollup(spark, sf_dir):
    return sk.roll_up(spark, daily_path(spark, sf_dir)).select(
        "calls", "low_similarity_calls", "low_similarity_pct", "compared", "agreed",
        *[F.round(f"total_{c}", 4).alias(f"total_{c}") for c in au.COSTS])


def sketch_quantiles_ok(spark, sf_dir):
    """Quantiles from daily sketches, and whether their exact ranks are within the stated error."""
    found = sk.quantiles(spark, daily_path(spark, sf_dir)).collect()  # three for each of three latencies
    log = comparisons.log_records(spark, sf_dir)
    ranks = log.agg(*[
        F.array((F.count_if(F.col(r["metric"]) < r["value"]) / r["n"]),
                (F.count_if(F.col(r["metric"]) <= r["value"]) / r["n"])).alias(f"r{i}")
        for i, r in enumerate(found)])
    rows = F.array(*[
        F.struct(F.lit(r["metric"]).alias("metric"), F.lit(r["p"]).alias("p"), F.lit(r["n"]).alias("n"),
                 ((F.col(f"r{i}")[0] - sk.RANK_ERROR <= r["p"])
                  & (F.col(f"r{i}")[1] + sk.RANK_ERROR >= r["p"])).alias("within"))
        for i, r in enumerate(found)])
    return ranks.select(F.explode(rows).alias("_r")).select("_r.*")


def rule_evidence(spark, sf_dir):
    """Every phrase of the rule set in every ticket, with its place."""
    tickets = messages.short_tickets(spark, sf_dir)
    return ev.evidence(tickets, "tweet_id", "text", ev.phrases_of(TRIAGE_RULES)).withColumnRenamed(
        "key", "tweet_id")


def rule_evidence_counts(spark, sf_dir):
    return staged(rule_evidence(spark, sf_dir), "evidence").groupBy("rule", "phrase").agg(
        F.count_distinct("tweet_id").alias("tickets"), F.count("*").alias("occurrences"))


QUERIES = {f.__name__: f for f in (
    csv_ranges, stream_first_ever, stream_first_ever_counts, stream_scored, scored_responses, document_status,
    completed_labels, completion_failures, daily_rollup, sketch_quantiles_ok, rule_evidence, rule_evidence_counts,
)}

PROMPT = vectors.filled(fv.LABEL_PROMPT, query="text")
PROMPTS = f"prompts as (select tweet_id, {PROMPT} as prompt from firsts)"
USD_IN, USD_OUT = fv.PRICES["primary"]
PHRASES = ", ".join("('{}', '{}')".format(rule, phrase.replace("'", "''"))
                    for rule, phrase in ev.phrases_of(TRIAGE_RULES))

ORACLES = {
    "csv_ranges": f"""with {sql.MESSAGES_SQL}
        select tweet_id, author_id, inbound, strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at,
          'say "' || text || '",' || chr(10) || 'please' as text, in_response_to_tweet_id from raw""",
    "stream_first_ever": f"""with {sql.CLEANED} select min_by(tweet_id, (epoch_ms(created_at), tweet_id)) as tweet_id, text
        from kept group by text""",
    "stream_first_ever_counts": f"""with {sql.CLEANED}
        select count(distinct text) as firsts, count(*) - count(distinct text) as copies from kept""",
    "stream_scored": f"""with {sql.CLEANED} select count(*) as rows, 0::bigint as different,
        1::bigint as version from kept""",
    "scored_responses": f"""with screened as ({comparisons.ORACLES['screened']})
        select count(*) as responses, 0::bigint as unavailable, 0::bigint as different
        from screened where outcome = 'accepted'""",
    "document_status": f"""with {sql.MESSAGES_SQL}
        select 'stats' as document, 'ready' as status, null::varchar as message, count(*) as raw_total from raw
        union all select 'metrics', 'not_run', 'Run the preparation job first.', null""",
    "completed_labels": f"""with {sql.CLEANED}, {PROMPTS}
        select tweet_id, case when length(prompt) % 10 = 0 then null
            when contains(lower(prompt), 'refund') then 'URGENT' else 'NORMAL' end as label,
          case when length(prompt) % 10 = 0 then 0e0
            else round((length(prompt) * {USD_IN} + 6 * {USD_OUT}) / 1000000, 6) end as cost_usd
        from prompts""",
    "completion_failures": f"""with {sql.CLEANED}, {PROMPTS}
        select distinct sha256(prompt) as prompt_hash, {TRIES}::bigint as calls,
          '{fv.COMPLETION_ERROR_PREFIX}: refused]' as message from prompts where length(prompt) % 10 = 0""",
    "daily_rollup": comparisons.ORACLES["audit_rollup"],
    "sketch_quantiles_ok": f"""with {sql.PARSED}, l as (
          select 'rag_latency_ms' as metric, rag_latency_ms as v from log
          union all select 'non_rag_latency_ms', non_rag_latency_ms from log
          union all select 'llm_latency_ms', llm_latency_ms from log)
        select metric, p::double as p, count(v) as n, true as within
        from l, (values (0.5), (0.95), (0.99)) as t(p) group by metric, p""",
    "rule_evidence_counts": f"""with {sql.CLEANED}, phrases(rule, phrase) as (values {PHRASES}),
        found as (select rule, phrase, len(regexp_extract_all(text, '(?i)\\b(?:' || phrase || ')\\b')) as n
          from firsts, phrases)
        select rule, phrase, count(*) as tickets, sum(n)::bigint as occurrences from found where n > 0
        group by rule, phrase""",
}
