"""Routing, cleaning, duplicates and the reply join."""

from pyspark.sql import functions as F

from tests import twins
from ticketloom.catalog.recipes import raw_messages
from ticketloom.operators import cleaning as cl
from ticketloom.operators import replies as rp
from ticketloom.operators import routing as ro
from ticketloom.plans import preparation as prep
from ticketloom.schemas import RAW


def messages(spark, rows):
    return spark.createDataFrame(rows, RAW)


def ask(i, text, inbound=True):
    return (i, f"u{i}", inbound, "t", text, None)


def reply(i, parent, text, inbound=False):
    return (i, "agent", inbound, "t", text, parent)


def test_regression_counts(spark, sf):
    raw = raw_messages(spark, sf)
    tickets = prep.clean_tickets(raw)
    assert tickets.count() == 368
    answered = tickets.filter(F.length("agent_response") > 0)
    assert answered.count() == 39
    assert answered.filter(F.col("agent_response").contains(" | ")).count() == 16
    assert tickets.columns == ["tweet_id", "customer_id", "airline", "created_at", "inbound",
                               "original_text", "text", "agent_response"]


def test_missing_direction_is_an_agent_row(spark):
    raw = messages(spark, [ask(1, "@Delta bag is lost"), ask(2, "@Delta hello you", None),
                           reply(3, 1, "we are looking into it", None)])
    assert [r["tweet_id"] for r in ro.inbound_rows(raw).collect()] == [1]
    assert ro.outbound_rows(raw).count() == 2
    assert prep.clean_tickets(raw).first()["agent_response"] == "we are looking into it"


def test_routing_keeps_the_typed_case_and_reads_past_blanks(spark):
    raw = messages(spark, [ask(1, "@DELTA where is it"), ask(2, "  @Delta where is it"),
                           ask(3, "http://u @Delta where"), ask(4, "@DeltaX no"), ask(5, None)])
    rows = {r["tweet_id"]: r for r in cl.with_clean_text(ro.route_to_brands(raw)).collect()}
    assert {i: r["airline"] for i, r in rows.items()} == {1: "DELTA", 2: "Delta"}
    # the mention goes only when it is the first character
    assert rows[1]["text"] == "where is it" and rows[2]["text"] == "@Delta where is it"


def test_brand_list_forms_agree(spark, sf):
    raw = raw_messages(spark, sf)
    brands = ["delta", "JetBlue"]
    few = ro.route_to_brands(raw, brands)
    as_table = ro.route_to_brands(raw, spark.createDataFrame([(b,) for b in brands], "b string"))
    many = ro.route_to_brands(raw, brands + [f"brand{i}" for i in range(ro.SHORT_LIST)])
    ids = [sorted(r["tweet_id"] for r in df.select("tweet_id").collect())
           for df in (few, as_table, many)]
    assert ids[0] and ids[0] == ids[1] == ids[2]


def test_only_thank_you_is_long_enough_to_be_bare(spark):
    texts = ["DM sent", "thanks", "Thank You", "help", "thank you!", "1234567", "12345678"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    kept = [r["text"] for r in cl.drop_low_quality(df).collect()]
    assert kept == ["thank you!", "12345678"]


def test_dedup_keeps_the_smallest_key_and_is_idempotent(spark):
    rows = [(9, "b", "same"), (2, "c", "same"), (5, None, "other"), (7, "x", None), (3, "y", None)]
    df = spark.createDataFrame(rows, "tweet_id long, airline string, text string")
    once = cl.first_per_text(df)
    assert sorted(once.collect(), key=str) == sorted(cl.first_per_text(once).collect(), key=str)
    assert {(r["tweet_id"], r["airline"]) for r in once.collect()} == {
        (2, "c"), (5, None), (3, "y")}


def test_dedup_of_a_text_that_holds_a_third_of_all_rows_sends_one_row_per_task(spark):
    df = spark.range(0, 30_000, 1, 6).select(
        F.col("id").alias("tweet_id"),
        F.when(F.col("id") % 3 == 0, "same text").otherwise(F.col("id").cast("string")).alias("text"),
    )
    unique = cl.first_per_text(df)
    assert unique.count() == 20_001
    assert unique.filter("text = 'same text'").first()["tweet_id"] == 0
    plan = unique._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_min") > plan.index("Exchange")


def test_counts_agree_with_the_steps(spark, sf):
    raw = raw_messages(spark, sf)
    counts = cl.cleaning_counts(raw).first().asDict()
    routed = cl.with_clean_text(ro.route_to_brands(raw))
    kept = cl.drop_low_quality(cl.drop_empty(routed))
    assert counts["raw_total"] == raw.count() == 1000
    assert counts["raw_inbound_count"] == 791
    assert counts["after_airline_filter"] == routed.count()
    assert counts["removed_empty"] == routed.filter("text = ''").count()
    assert counts["removed_duplicates"] == kept.count() - 368
    assert counts["final_count"] == 368
    assert cl.drop_null_text(cl.first_per_text(kept)).count() == 368
    empty = cl.with_retention(cl.cleaning_counts(raw.limit(0))).first()
    assert empty["final_count"] == 0 and empty["retention_pct"] == 0.0


def test_cleaning_runs_once_per_row(spark, sf):
    plan = cl.tidy_tickets(raw_messages(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("www[^") == 1


def test_replies_join_in_key_order(spark):
    raw = messages(spark, [
        ask(1, "@Delta bag is lost"), ask(2, "@Delta late again"), ask(3, "@Delta no answer here"),
        reply(30, 1, "@u1 second answer http://x.y"), reply(20, 1, "@u1 first &amp; answer"),
        reply(21, 1, "short"), reply(22, None, "no parent at all"),
        reply(23, 2, "an answer to two", True),
    ])
    rows = {r["tweet_id"]: r["agent_response"] for r in prep.clean_tickets(raw).collect()}
    assert rows == {1: "first & answer | second answer", 2: "", 3: ""}
    coverage = rp.reply_coverage(cl.tidy_tickets(raw), raw).first()
    assert coverage.asDict() == {"final_count": 3, "with_agent_response": 1,
                                 "agent_response_pct": 33.3}
    assert rp.reply_coverage(cl.tidy_tickets(raw.limit(0)), raw).first()["agent_response_pct"] == 0


def test_a_hot_parent_keeps_its_whole_text_in_ticket_payload_and_counts(spark):
    from ticketloom.operators.payload import payload_column, with_chunks

    texts = [f"answer number {i:04d}" for i in range(300)]
    rows = [ask(1, "@Delta where is my bag"), ask(2, "@Delta where is my seat"),
            reply(1000, 2, "a single answer")]
    rows += [reply(2000 + i, 1, t) for i, t in enumerate(texts)]
    raw = messages(spark, rows)
    parts = [r for r in rp.reply_parts(raw, part_chars=1000).orderBy("part_no").collect()
             if r["parent_id"] == 1]
    assert len(parts) > 5
    assert max(len(p["part"]) for p in parts) < 1100
    assert " | ".join(p["part"] for p in parts) == " | ".join(texts)
    assert sum(p["replies"] for p in parts) == 300
    for size in (40, 1000, rp.PART_CHARS):
        tickets = rp.attach_replies(cl.tidy_tickets(raw), raw, part_chars=size)
        got = {r["tweet_id"]: r["agent_response"] for r in tickets.collect()}
        assert got == {1: " | ".join(texts), 2: "a single answer"}
    chunked = with_chunks(tickets)
    held = {r["p"]["tweet_id"]: r["p"]["agent_response"]
            for r in chunked.select(payload_column(chunked).alias("p")).collect()}
    assert held == got
    assert prep.coverage_of(tickets).first()["with_agent_response"] == 2


def test_raw_text_without_a_qualified_reply_is_no_answer(spark):
    raw = messages(spark, [ask(1, "@Delta where is my bag")]
                   + [reply(10 + i, 1, "@customer12345 ok") for i in range(50)])
    tickets = rp.attach_replies(cl.tidy_tickets(raw), raw, part_chars=100)
    assert tickets.first()["agent_response"] == ""


def test_preparation_writes_every_stage(spark, sf, tmp_path):
    done = prep.prepare(raw_messages(spark, sf), str(tmp_path))
    assert [df.count() for df in (done.cleaned, done.labeled, done.features)] == [368] * 3
    stats = done.stats.first()
    assert stats["final_count"] == 368 and stats["with_agent_response"] == 39
    assert stats["agent_response_pct"] == 10.6
    assert stats["labeling"]["urgent"] + stats["labeling"]["normal"] == 368
    assert stats["pipeline_run_at"].endswith("+00:00")
    sample = done.cleaned.limit(50).collect()
    assert all(r["text"] == twins.clean(r["original_text"]) for r in sample)


def test_recreated_messages_exercise_both_classes_and_every_score(spark, sf):
    from ticketloom.functions.rules import label_table

    rows = label_table(cl.tidy_tickets(raw_messages(spark, sf))).groupBy("score", "priority").count()
    got = {r["score"]: (r["priority"], r["count"]) for r in rows.collect()}
    assert {s: n for s, (_, n) in got.items()} == {
        0: 80, 1: 14, 2: 89, 3: 27, 4: 14, 5: 65, 6: 12, 7: 14, 8: 14, 10: 39}
    assert all((p == "URGENT") == (s >= 3) for s, (p, _) in got.items())
