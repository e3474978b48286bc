"""The fourteen model features as column expressions."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom import fixed_values as fv
from ticketloom.functions import text as tx


def contains_any(text: Column, stems: Sequence[str]) -> Column:
    """A plain search that spares rows without any stem the pattern behind it."""
    found = text.contains(stems[0])
    for stem in stems[1:]:
        found = found | text.contains(stem)
    return found


def feature_columns(text: Column) -> dict[str, Column]:
    """Features of one text column, in training order; null text counts as ''."""
    body = F.coalesce(text, F.lit(""))
    lowered = F.lower(body)
    size = F.length(body)
    profane = F.regexp_count(
        lowered, F.lit("(?U)" + tx.whole_words("|".join(fv.FEATURE_PROFANITY)))
    )
    columns = {
        "text_length": size,
        "word_count": tx.word_count(body),
        "exclamation_count": tx.occurrences(body, "!"),
        "question_count": tx.occurrences(body, "?"),
        # a share of all characters, unlike the labeller's share of letters
        "caps_ratio": tx.uppercase_count(body) / F.greatest(size, F.lit(1)),
        "profanity_count": F.when(
            contains_any(lowered, fv.FEATURE_PROFANITY), profane
        ).otherwise(0),
    }
    for name, pattern in fv.FEATURE_PATTERNS.items():
        occurs = contains_any(lowered, fv.FEATURE_STEMS[name])
        inner = pattern.removeprefix(r"\b").removesuffix(r"\b")
        whole = tx.whole_words(inner, open_end=not pattern.endswith(r"\b"))
        matches = lowered.rlike("(?U)" + whole)
        columns[name] = (occurs & matches).cast("int")
    return {name: columns[name] for name in fv.FEATURES}


def add_features(df: DataFrame, text_column: str = "text") -> DataFrame:
    """Attach the features; columns of the same name are replaced."""
    if text_column not in df.columns:
        raise KeyError(f"no text column {text_column!r}; the table has {df.columns}")
    return df.withColumns(feature_columns(F.col(text_column)))


def feature_table(labeled: DataFrame, text_column: str = "text") -> DataFrame:
    """The training table: ids, target, four rule flags and the fourteen features.

    Absent optional columns are left out.
    """
    wide = labeled.withColumn("is_urgent", (F.col("priority") == "URGENT").cast("int"))
    wide = add_features(wide, text_column)
    keep = (
        "tweet_id", "airline", "created_at",
        "is_urgent", "priority", "score",
        "has_urgency_keywords", "has_critical_signal", "has_profanity", "has_sarcasm",
        *fv.FEATURES,
    )
    present = set(wide.columns)
    return wide.select(*[name for name in keep if name in present])


def fill_missing_features(df: DataFrame) -> DataFrame:
    return df.fillna(0, subset=list(fv.FEATURES))
