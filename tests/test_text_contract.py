"""Expressions against plain-Python statements of the same contract."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests import awkward, twins
from ticketloom import fixed_values as fv
from ticketloom.functions import text as tx
from ticketloom.functions.features import add_features
from ticketloom.functions.rules import TRIAGE_RULES, PhraseRule, RuleSet, label_table


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def check(spark, texts):
    df = table(spark, texts)
    cleaned = df.select("id", "text", tx.clean_text(F.col("text")).alias("c"),
                        tx.leading_handle(F.col("text")).alias("h"))
    for row in cleaned.collect():
        assert row["c"] == twins.clean(row["text"]), repr(row["text"])
        assert row["h"] == twins.handle(row["text"]), repr(row["text"])
    for row in label_table(df).collect():
        assert (row["score"], row["priority"]) == twins.label(row["text"]), repr(row["text"])
        assert row["score"] != 9
    for row in add_features(df).collect():
        expected = twins.features(row["text"])
        assert {k: row[k] for k in fv.FEATURES} == expected, repr(row["text"])


def test_awkward_texts(spark):
    check(spark, awkward.texts())


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_categories=("Cs",)),
                        max_size=30), min_size=20, max_size=60))
def test_arbitrary_texts_clean_and_count(spark, texts):
    df = table(spark, [t.replace("\x00", "") for t in texts])
    rows = df.select("text", tx.clean_text(F.col("text")).alias("c"),
                     tx.word_count(F.col("text")).alias("w")).collect()
    for row in rows:
        assert row["c"] == twins.clean(row["text"])
        assert row["w"] == len(row["text"].split())


CASES = {
    "a medical emergency in row nine": ("URGENT", 10),
    "our plane is delayed": ("URGENT", 5),
    "smooth trip, many thanks": ("NORMAL", 0),
    "   ": ("NORMAL", 0),
    "missing": ("NORMAL", 2),
}


def test_label_cases(spark):
    rows = label_table(table(spark, list(CASES) + [None])).collect()
    got = {r["text"]: (r["priority"], r["score"]) for r in rows}
    assert got.pop(None) == ("NORMAL", 0)
    assert got == CASES


def test_missing_is_an_urgency_word_and_no_flag_of_its_own(spark):
    df = label_table(table(spark, ["one suitcase is missing"]))
    assert "has_missing" not in df.columns
    assert df.first()["has_urgency_keywords"] is True


def test_feature_cases(spark):
    rows = {r["text"]: r for r in add_features(table(spark, [
        "stranded in Oslo: trip cancelled, refund please!",
        "sunny morning at the terminal", "HELP", "help", "seriously?! again?!",
        "in the queue for 3 hours", "nothing on the clock",
    ])).collect()}
    first = rows["stranded in Oslo: trip cancelled, refund please!"]
    assert (first["has_refund"], first["has_cancel"], first["has_stranded"]) == (1, 1, 1)
    assert first["exclamation_count"] == 1
    calm = rows["sunny morning at the terminal"]
    assert [calm[c] for c in ("has_refund", "has_cancel", "has_delay", "profanity_count")] == [0] * 4
    assert (rows["HELP"]["caps_ratio"], rows["help"]["caps_ratio"]) == (1.0, 0.0)
    both = rows["seriously?! again?!"]
    assert (both["question_count"], both["exclamation_count"]) == (2, 2)
    assert rows["in the queue for 3 hours"]["has_time_mention"] == 1
    assert rows["nothing on the clock"]["has_time_mention"] == 0


def test_fourteen_features(spark):
    df = add_features(table(spark, ["any text"]))
    assert df.columns == ["id", "text", *fv.FEATURES] and len(fv.FEATURES) == 14


def test_text_column_is_required(spark):
    with pytest.raises(KeyError):
        label_table(spark.range(1), "body")
    with pytest.raises(KeyError):
        add_features(spark.range(1))


def test_rule_set_is_data(spark):
    rules = RuleSet(rules=(PhraseRule("is_fire", ["fire"]), PhraseRule("is_hot", ["hot"], 5)),
                    override_flag="is_fire", override_score=99, urgent_from=5)
    rows = label_table(table(spark, ["hot", "fire", "cold"]), rules=rules).collect()
    assert [(r["score"], r["priority"]) for r in rows] == [
        (5, "URGENT"), (99, "URGENT"), (0, "NORMAL")]
    with pytest.raises(ValueError):
        RuleSet(rules=TRIAGE_RULES.rules, override_flag="nope", override_score=1)


@pytest.mark.parametrize("cell, value", [
    ("12", 12), ("12.0", 12), (" 12 ", 12), ("x", None), (None, None), ("", None),
    ("9007199254740993", 9007199254740993), ("12.9", 12),
])
def test_to_long(spark, cell, value):
    df = spark.createDataFrame([(cell,)], "v string")
    assert df.select(tx.to_long(F.col("v")).alias("n")).first()["n"] == value
