"""Answer a table of queries: guard, retrieve, build prompts, score, and record.

What a web service does per request is done here once for all queries.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom import fixed_values as fv
from ticketloom.functions import prompts as pr
from ticketloom.operators.encoding import encode
from ticketloom.operators.similarity import hit_lists, hit_rows, low_similarity, top_k
from ticketloom.plans.training import score_texts
from ticketloom.sources.tables import staged


@dataclass
class Triage:
    accepted: DataFrame
    blocked: DataFrame
    rejected: DataFrame


def screen(queries: DataFrame, verdict: str | None = None) -> Triage:
    """Blank queries are rejected, guarded ones blocked with a reason, the rest accepted.

    `verdict` names a column of topic verdicts, the second tier of the guard.
    """
    usable, rejected = pr.split_blank(queries)
    judged = pr.guarded(usable, verdict=verdict)
    return Triage(
        judged.filter(F.col("reason").isNull()).drop("reason", "code", "message", "hint"),
        judged.filter(F.col("reason").isNotNull()),
        rejected,
    )


def retrieve(queries: DataFrame, vectors: DataFrame, encoder, dim: int, k: int = fv.TOP_K,
             floor: float = fv.SIMILARITY_FLOOR) -> DataFrame:
    """Ranked hits with ticket fields for a table (query_id, query).

    Every distinct text is encoded and searched once; its hits go back to all queries that ask
    it. Spark splits the join partitions of very frequent texts.
    """
    distinct = queries.filter(F.col("query").isNotNull()).groupBy("query").agg(
        F.min("query_id").alias("asked_id")
    )
    asked = encode(encoder, distinct, "query")
    hits = staged(top_k(asked, vectors, dim, k, floor, query_id="asked_id"), "hits")
    found = hit_rows(hits, vectors).withColumnRenamed("query_id", "asked_id")
    same = queries.select("query_id", "query").join(distinct, "query").drop("query")
    return same.join(found, "asked_id").drop("asked_id")


def respond(accepted: DataFrame, hits: DataFrame, model=None,
            threshold: float = fv.SIMILARITY_FLOOR) -> DataFrame:
    """One wide row per query: hits, weak-context mark, prompts and the classifier's answer."""
    weak = low_similarity(accepted, hits, threshold=threshold)
    joined = (
        accepted.select("query_id", "query")
        .join(weak, "query_id")
        .join(hit_lists(hits), "query_id", "left")
    )
    scored = score_texts(model, joined, "query")
    return scored.select(
        "query_id", "query", "hits", "retrieved_count", "best_similarity", "low_similarity",
        pr.answer_prompt(F.col("query"), F.col("hits")).alias("context_prompt"),
        pr.label_prompt(F.col("query")).alias("label_prompt"),
        F.col("label").alias("ml_label"), F.col("confidence").alias("ml_confidence"),
        F.col("cost_usd").alias("ml_cost_usd"),
    )


def respond_all(accepted: DataFrame, vectors: DataFrame, encoder, dim: int, model=None, **options) -> DataFrame:
    """`retrieve` and `respond` for a log whose texts repeat: the row of a text is made once.

    All but the id follows from the text, so hits and prompts are not gathered again for every query.
    """
    texts = staged(accepted.groupBy("query").agg(F.min("query_id").alias("query_id")), "texts")
    hits = staged(retrieve(texts, vectors, encoder, dim, **options), "text-hits")
    answered = respond(texts, hits, model)
    rows = staged(answered.drop("query_id"), "text-responses")
    return accepted.select("query_id", "query").join(rows, "query").select(*answered.columns)


def audit_records(responses: DataFrame, calls: DataFrame) -> DataFrame:
    """Log records from responses and the completion calls per query.

    `calls` holds query_id, rag_latency_ms, rag_cost_usd, non_rag_latency_ms, non_rag_cost_usd,
    llm_completion, llm_latency_ms, llm_cost_usd.
    """
    return responses.join(calls, "query_id").select(
        "query", "retrieved_count", "low_similarity",
        "rag_latency_ms", "rag_cost_usd", "non_rag_latency_ms", "non_rag_cost_usd",
        "ml_label", "ml_confidence",
        pr.parsed_label(F.col("llm_completion")).alias("llm_label"),
        "llm_latency_ms", "llm_cost_usd",
    )
