"""Guard, completion, cost, comparison and audit queries over the derived query log."""

from pyspark.sql import functions as F

from ticketloom import fixed_values as fv
from ticketloom.catalog import sql
from ticketloom.catalog.models import NAMES, judged_documents
from ticketloom.catalog.recipes import query_calls
from ticketloom.functions import prompts as pr
from ticketloom.operators import audit as au
from ticketloom.operators import costs as co
from ticketloom.operators import evaluation as ev
from ticketloom.plans import answering
from ticketloom.session import scratch_path
from ticketloom.sources.audit_log import append_log, read_log


def scope_guard(spark, sf_dir):
    judged = pr.guarded(query_calls(spark, sf_dir))
    return judged.select("query_id", "query", "reason", "message")


def scope_guard_verdicts(spark, sf_dir):
    """Both tiers of the guard: patterns, then the completions read as topic verdicts."""
    triage = answering.screen(query_calls(spark, sf_dir).select("query_id", "query", "completion"),
                              verdict="completion")
    return triage.blocked.select("query_id", "reason", "code", "message", "hint")


def screened(spark, sf_dir):
    """What became of every query: accepted, blocked or rejected."""
    triage = answering.screen(query_calls(spark, sf_dir).select("query_id", "query"))
    parts = {"accepted": triage.accepted, "blocked": triage.blocked, "rejected": triage.rejected}
    frames = [df.select("query_id", F.lit(name).alias("outcome")) for name, df in parts.items()]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def label_parse(spark, sf_dir):
    return query_calls(spark, sf_dir).select(
        "query_id", "completion",
        pr.parsed_label(F.col("completion")).alias("llm_label"),
        pr.is_error(F.col("completion")).alias("is_error"),
        pr.is_allowed(F.col("completion")).alias("is_allowed"),
    )


def costed(spark, sf_dir):
    calls = query_calls(spark, sf_dir).withColumn(
        "llm_label", pr.parsed_label(F.col("completion"))
    )
    return co.with_cost(calls)


def token_cost(spark, sf_dir):
    return costed(spark, sf_dir).select(
        "query_id", "cost_usd", F.round(co.hourly_cost(F.col("cost_usd")), 4).alias("hourly_usd")
    )


def pairs(spark, sf_dir):
    calls = costed(spark, sf_dir)
    model = calls.filter(F.col("ml_label") != "UNAVAILABLE").select(
        F.col("query_id").alias("ticket_id"), F.col("ml_label").alias("label"),
        F.col("ml_confidence").alias("confidence"),
        (F.col("non_rag_latency_ms") / 1024).alias("latency_ms"),
    )
    completion = calls.filter(~pr.is_error(F.col("completion"))).select(
        F.col("query_id").alias("ticket_id"), F.col("llm_label").alias("label"),
        F.col("llm_latency_ms").alias("latency_ms"), "cost_usd",
    )
    return co.side_by_side(model, completion)


def comparison(spark, sf_dir):
    """Both predictions per ticket, also where only one classifier answered."""
    return pairs(spark, sf_dir).select(
        "ticket_id", "ml_label", "llm_label", "agree", "ml_confidence", "llm_latency_ms",
        "llm_cost_usd",
    )


def comparison_rows(spark, sf_dir):
    """All eight display rows with the selected model's test metrics."""
    metrics = ev.compare_models(ev.binary_metrics(judged_documents(spark, sf_dir)), NAMES)
    return co.comparison_rows(co.with_test_metrics(pairs(spark, sf_dir), metrics))


def log_records(spark, sf_dir, *extra):
    calls = costed(spark, sf_dir)
    return calls.select(
        "query", "retrieved_count", "low_similarity", "rag_latency_ms",
        F.col("cost_usd").alias("rag_cost_usd"), "non_rag_latency_ms",
        F.lit(0.0).alias("non_rag_cost_usd"), "ml_label", "ml_confidence", "llm_label",
        "llm_latency_ms", F.col("cost_usd").alias("llm_cost_usd"), *extra,
    )


def audit_records(spark, sf_dir):
    """Audit records built from response rows and completion calls."""
    calls = costed(spark, sf_dir)
    responses = calls.select("query_id", "query", "retrieved_count", "low_similarity",
                             "ml_label", "ml_confidence")
    completions = calls.select(
        "query_id", "rag_latency_ms", F.col("cost_usd").alias("rag_cost_usd"),
        "non_rag_latency_ms", F.lit(0.0).alias("non_rag_cost_usd"),
        F.col("completion").alias("llm_completion"), "llm_latency_ms",
        F.col("cost_usd").alias("llm_cost_usd"),
    )
    return answering.audit_records(responses, completions)


def audit_append(spark, sf_dir):
    """The log appended to in two runs and read back."""
    path = scratch_path(spark, "audit")
    records = log_records(spark, sf_dir)
    append_log(records.filter(F.col("low_similarity")), path)
    append_log(records.filter(~F.col("low_similarity")), path)
    return read_log(spark, path).drop("timestamp")


def audit_rollup(spark, sf_dir):
    rolled = au.roll_up(log_records(spark, sf_dir))
    costs = [f"total_{c}" for c in au.COSTS]
    return rolled.select("calls", "low_similarity_calls", "low_similarity_pct", "compared",
                         "agreed", *[F.round(c, 4).alias(c) for c in costs])


def latency_quantiles(spark, sf_dir):
    from ticketloom.catalog.profiles import rounded

    return rounded(au.latency_quantiles(log_records(spark, sf_dir)))


def agreement_matrix(spark, sf_dir):
    return au.agreement_matrix(log_records(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    scope_guard, scope_guard_verdicts, screened, label_parse, token_cost, comparison, comparison_rows, audit_records,
    audit_append, audit_rollup, latency_quantiles, agreement_matrix,
)}


def guard(text: str) -> str:
    tests = " ".join(
        f"when regexp_matches({text}, '(?i){pattern}') then '{reason}'"
        for reason, pattern in fv.GUARD_RULES
    )
    return f"case {tests} end"


STRIPPED = "regexp_replace(query, '^\\s+|\\s+$', '', 'g')"
MESSAGES = " ".join(
    "when '{}' then '{}'".format(k, v.replace("'", "''")) for k, v in fv.BLOCK_MESSAGES.items()
)
GUARDED = f"guarded as (select *, {guard(STRIPPED)} as reason from calls)"
ERROR = f"starts_with(completion, '{fv.COMPLETION_ERROR_PREFIX}')"
SIDES = f"""sides as (select query_id as ticket_id,
    case when ml_label <> 'UNAVAILABLE' then ml_label end as ml_label,
    case when not {ERROR} then llm_label end as llm_label,
    case when ml_label <> 'UNAVAILABLE' then ml_confidence end as ml_confidence,
    case when ml_label <> 'UNAVAILABLE' then non_rag_latency_ms / 1024 end as ml_latency_ms,
    case when not {ERROR} then llm_latency_ms end as llm_latency_ms,
    case when not {ERROR} then cost_usd end as llm_cost_usd
  from costed where ml_label <> 'UNAVAILABLE' or not {ERROR})"""
LOG_FIELDS = """query, retrieved_count, low_similarity, rag_latency_ms, cost_usd as rag_cost_usd,
    non_rag_latency_ms, 0.0::double as non_rag_cost_usd, ml_label, ml_confidence, llm_label,
    llm_latency_ms, cost_usd as llm_cost_usd"""


def comparison_sql() -> str:
    from ticketloom.catalog.models import ORACLES as MODELS

    lines = (
        (0, "Prediction", "coalesce(ml_label, '—')", "coalesce(llm_label, '—')"),
        (1, "Confidence", "coalesce(printf('%.1f%%', 100 * ml_confidence), '—')", "'—'"),
        (2, "Test Accuracy", "printf('%.1f%%', 100 * test_accuracy)", "'—'"),
        (3, "F1 (test)", "printf('%.3f', test_f1)", "'—'"),
        (4, "ROC-AUC (test)", "printf('%.3f', test_roc_auc)", "'—'"),
        # halves are rounded up, where printf would round them to even
        (5, "Latency / call", "coalesce(printf('%.3f ms', floor(ml_latency_ms * 1000 + 0.5) / 1000), '—')",
         "coalesce(printf('%.0f ms', floor(llm_latency_ms + 0.5)), '—')"),
        (6, "Cost / call", "'$0.000000'", "coalesce(printf('$%.6f', llm_cost_usd), '—')"),
        (7, "Cost @ 10,000 tickets / hr", "'$0.00'",
         "coalesce(printf('$%.2f/hr', llm_cost_usd * 10000), '—')"),
    )
    rows = " union all ".join(
        f"select ticket_id, {i} as position, '{name}' as measure, {ml} as ml, {llm} as llm"
        f" from sides, best" for i, name, ml, llm in lines
    )
    return f"""with {sql.PARSED}, {SIDES},
        best as (select * from ({MODELS['model_selection']}) where is_best) {rows}"""


ORACLES = {
    "scope_guard": f"""with {sql.CALLS}, {GUARDED}
        select query_id, query, reason, case reason {MESSAGES} end as message from guarded""",
    "scope_guard_verdicts": f"""with {sql.CALLS}, {GUARDED}, judged as (
          select query_id, coalesce(reason,
            case when starts_with(upper(substr(trim(completion), 1, 3)), 'NO') then 'off_topic' end)
            as reason from guarded where {STRIPPED} <> '')
        select query_id, reason, 'off_topic' as code, case reason {MESSAGES} end as message,
          '{fv.SCOPE_HINT}' as hint from judged where reason is not null""",
    "screened": f"""with {sql.CALLS}, {GUARDED}
        select query_id, case when {STRIPPED} = '' then 'rejected'
          when reason is not null then 'blocked' else 'accepted' end as outcome from guarded""",
    "label_parse": f"""with {sql.PARSED}
        select query_id, completion, llm_label, {ERROR} as is_error,
          not starts_with(upper(substr(trim(completion), 1, 3)), 'NO') as is_allowed from log""",
    "token_cost": f"""with {sql.PARSED}
        select query_id, cost_usd, round(cost_usd * 10000, 4) as hourly_usd from costed""",
    "comparison": f"""with {sql.PARSED}, {SIDES}
        select ticket_id, ml_label, llm_label, ml_label = llm_label as agree, ml_confidence,
          llm_latency_ms, llm_cost_usd from sides""",
    "comparison_rows": comparison_sql(),
    "audit_records": f"with {sql.PARSED} select {LOG_FIELDS} from costed",
    "audit_append": f"with {sql.PARSED} select {LOG_FIELDS} from costed",
    "audit_rollup": f"""with {sql.PARSED}
        select count(*) as calls, count(*) filter (where low_similarity) as low_similarity_calls,
          100e0 * avg(low_similarity::int) as low_similarity_pct,
          count(*) filter (where ml_label <> 'UNAVAILABLE') as compared,
          count(*) filter (where ml_label = llm_label) as agreed,
          round(sum(cost_usd), 4) as total_rag_cost_usd, 0e0 as total_non_rag_cost_usd,
          round(sum(cost_usd), 4) as total_llm_cost_usd from costed""",
    "latency_quantiles": f"""with {sql.PARSED}, l as (
          select 'rag_latency_ms' as metric, rag_latency_ms as v from log
          union all select 'non_rag_latency_ms', non_rag_latency_ms from log
          union all select 'llm_latency_ms', llm_latency_ms from log)
        select metric, count(v) as count, round({sql.percentile('v', 0.5)}, 6) as p50,
          round({sql.percentile('v', 0.95)}, 6) as p95,
          round({sql.percentile('v', 0.99)}, 6) as p99 from l group by metric""",
    "agreement_matrix": f"""with {sql.PARSED}
        select ml_label, count(*) filter (where llm_label = 'URGENT') as llm_urgent,
          count(*) filter (where llm_label = 'NORMAL') as llm_normal from log group by ml_label""",
}
