"""Text scalars, all of them built-in expressions.

Java's `\\s` leaves out the four separators U+001C..U+001F that count as white space in the
ticket contract, and is ASCII-only without `(?U)`; `WS` covers both. `WORD` is the contract's word character.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WS = r"[\s\x1c-\x1f]"
NOT_WS = r"[^\s\x1c-\x1f]"
WORD = r"[\p{L}\p{N}_]"
HANDLE = r"@([A-Za-z0-9_]+)"


def widen(pattern: str) -> str:
    """Make `\\s` and `\\b` in a pattern follow the ticket contract.

    `\\s` covers the same white space as WS, inside or outside a class. A word character is a
    letter, a number or `_`; Java's own Unicode boundary also counts combining marks and joiners.
    """
    either = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
    return pattern.replace(r"\s", WS).replace(r"\b", either)


def whole_words(pattern: str, open_end: bool = False) -> str:
    """A pattern that starts and ends in word characters, matched as whole words."""
    return f"(?<!{WORD})(?:{widen(pattern)})" + ("" if open_end else f"(?!{WORD})")


def strip(text: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.regexp_replace(text, rf"(?U)^{WS}+|{WS}+\z", "")


def handle_or_empty(text: Column) -> Column:
    """The handle a message opens with, ignoring leading white space; '' when there is none."""
    # Skipping the white space inside the pattern spares a separate strip of every row.
    return F.regexp_extract(text, rf"(?U)^{WS}*{HANDLE}", 1)


def leading_handle(text: Column) -> Column:
    """The handle, or null when there is none."""
    return F.nullif(handle_or_empty(text), F.lit(""))


def drop_urls(text: Column) -> Column:
    """Remove URLs. The plain search spares most rows the pattern."""
    bare = F.regexp_replace(text, rf"(?U)http{NOT_WS}+|www{NOT_WS}+", "")
    return F.when(text.contains("http") | text.contains("www"), bare).otherwise(text)


def drop_leading_mention(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{HANDLE}{WS}*", "")


def decode_ampersand(text: Column) -> Column:
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def squeeze(text: Column) -> Column:
    """Collapse every run of white space to one blank and trim."""
    return F.trim(F.regexp_replace(text, rf"(?U){WS}+", " "))


def clean_text(text: Column) -> Column:
    """URLs, then the leading mention, then entities, then white space; null becomes ''."""
    bare = drop_leading_mention(drop_urls(F.coalesce(text, F.lit(""))))
    return squeeze(decode_ampersand(bare))


def occurrences(text: Column, char: str) -> Column:
    """How often one character occurs."""
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(rf"(?U){NOT_WS}+"))


def letter_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\P{L}+", ""))


def uppercase_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\P{IsUppercase}+", ""))


def uppercase_letter_count(text: Column) -> Column:
    """Upper-case letters only: circled capitals are upper case but not letters."""
    return F.length(F.regexp_replace(text, r"[\P{L}\P{IsUppercase}]+", ""))


def to_long(value: Column) -> Column:
    """Whole-number coercion that yields null for anything unreadable ('12', '12.0', ' 12 ')."""
    text = value.cast("string")
    return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))


def long_column(df: DataFrame, name: str) -> Column:
    """A column as whole numbers; one that is typed already stays bare and can be pushed down."""
    column = F.col(name)
    return column if isinstance(df.schema[name].dataType, T.LongType) else to_long(column)
