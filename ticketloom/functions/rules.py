"""Weak-supervision labelling: a rule set is data, the flags and the score are expressions."""

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom import fixed_values as fv
from ticketloom.functions import text as tx


@dataclass(frozen=True)
class PhraseRule:
    """A flag raised when any phrase occurs as whole words; `points` feed the score."""

    flag: str
    phrases: Sequence[str]
    points: int = 0

    def pattern(self) -> str:
        # One boundary pair around the alternatives: the matcher tests each start once.
        return "(?iU)" + tx.whole_words("|".join(self.phrases))

    def matches(self, text: Column) -> Column:
        return F.coalesce(text.rlike(self.pattern()), F.lit(False))


@dataclass(frozen=True)
class RuleSet:
    """Phrase rules, one overriding flag, two style rules and the decision threshold."""

    rules: Sequence[PhraseRule]
    override_flag: str
    override_score: int
    caps_limit: float = fv.CAPS_LIMIT
    caps_points: int = fv.CAPS_POINTS
    exclamation_limit: int = fv.EXCLAMATION_LIMIT
    exclamation_points: int = fv.EXCLAMATION_POINTS
    urgent_from: int = fv.URGENT_FROM
    flags: Sequence[str] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "flags", tuple(r.flag for r in self.rules))
        if self.override_flag not in self.flags:
            raise ValueError(f"override flag {self.override_flag!r} is not one of {self.flags}")


TRIAGE_RULES = RuleSet(
    rules=(
        PhraseRule("has_critical_signal", fv.CRITICAL_WORDS),
        PhraseRule("has_urgency_keywords", fv.URGENCY_WORDS, fv.URGENCY_POINTS),
        PhraseRule("has_delay", fv.DELAY_PHRASES, fv.DELAY_POINTS),
        PhraseRule("has_profanity", fv.PROFANITY_WORDS, fv.PROFANITY_POINTS),
        PhraseRule("has_sarcasm", fv.SARCASM_PHRASES),
    ),
    override_flag="has_critical_signal",
    override_score=fv.CRITICAL_SCORE,
)


def letter_caps_ratio(text: Column) -> Column:
    """Share of upper-case letters among letters; 0 without letters."""
    return tx.uppercase_letter_count(text) / F.greatest(tx.letter_count(text), F.lit(1))


def signal_columns(text: Column, rules: RuleSet = TRIAGE_RULES) -> dict[str, Column]:
    """The flags, punctuation counts and share of capitals of one text column."""
    body = F.coalesce(text, F.lit(""))
    signals = {rule.flag: rule.matches(body) for rule in rules.rules}
    signals["exclamation_count"] = tx.occurrences(body, "!")
    signals["question_count"] = tx.occurrences(body, "?")
    signals["caps_ratio"] = letter_caps_ratio(body)
    return signals


def score_column(signals: dict[str, Column], rules: RuleSet = TRIAGE_RULES) -> Column:
    """Points of all raised signals, or the override score.

    Blank text needs no branch of its own: it raises nothing and scores 0.
    """
    points = [signals[r.flag].cast("int") * r.points for r in rules.rules if r.points]
    points.append((signals["caps_ratio"] > rules.caps_limit).cast("int") * rules.caps_points)
    points.append(
        (signals["exclamation_count"] >= rules.exclamation_limit).cast("int")
        * rules.exclamation_points
    )
    total = points[0]
    for extra in points[1:]:
        total = total + extra
    return F.when(signals[rules.override_flag], F.lit(rules.override_score)).otherwise(total)


def priority_column(score: Column, rules: RuleSet = TRIAGE_RULES) -> Column:
    return F.when(score >= rules.urgent_from, "URGENT").otherwise("NORMAL")


def label_table(df: DataFrame, text_column: str = "text",
                rules: RuleSet = TRIAGE_RULES) -> DataFrame:
    """Attach priority, score and every signal to a table with a text column."""
    if text_column not in df.columns:
        raise KeyError(f"no text column {text_column!r}; the table has {df.columns}")
    # Two steps: the signals are computed once in their own projection, the score reads them.
    raised = df.withColumns(signal_columns(F.col(text_column), rules))
    names = (*rules.flags, "exclamation_count", "question_count", "caps_ratio")
    score = score_column({name: F.col(name) for name in names}, rules)
    scored = raised.withColumn("score", score)
    return scored.withColumn("priority", priority_column(F.col("score"), rules)).select(
        *df.columns, "priority", "score", *names
    )
