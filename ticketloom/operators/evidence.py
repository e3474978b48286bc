"""Why a rule fired: every phrase of a rule table with its place, in one pass over each text.

All phrases go into one automaton (Aho-Corasick), so the cost of a text does not grow with the table; an
alternation tries its phrases one after the other at each place. Phrases match in any case and as whole
words: a match neither starts nor ends inside a run of letters, numbers and `_`. Every occurrence counts,
overlapping ones and phrases within phrases too. Entries of a rule set that are patterns rather than plain
phrases are searched for beside the automaton, their occurrences left to right.

The table is a parameter that every worker holds; MOST_PHRASES bounds it. Null texts have no evidence.
"""

import re
from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.functions.rules import RuleSet

MOST_PHRASES = 1_000_000
WORD = r"[\p{L}\p{N}_]"
FIELDS = "key long, rule string, phrase string, start int, stop int"
PLAIN = re.compile(r"[^\\.^$*+?{}\[\]|()]+")


def folded(text: str) -> str:
    """Lower case, character by character, so that places stay the same."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(
        c.lower() if len(c.lower()) == 1 else c for c in text)


def phrases_of(rules: RuleSet) -> list[tuple[str, str]]:
    return [(rule.flag, phrase) for rule in rules.rules for phrase in rule.phrases]


class Matcher:
    """The automaton and patterns of a rule table, built once per worker."""

    def __init__(self, phrases: Sequence[tuple[str, str]]):
        self.automaton, by_phrase, self.patterns = ahocorasick.Automaton(), {}, []
        for rule, phrase in phrases:
            if PLAIN.fullmatch(phrase):
                by_phrase.setdefault(folded(phrase), []).append((rule, phrase))
            elif phrase:
                whole = f"(?<!{WORD})(?:{phrase})(?!{WORD})"
                self.patterns.append((rule, phrase, regex.compile(whole, regex.IGNORECASE)))
        for low, entries in by_phrase.items():
            self.automaton.add_word(low, (len(low), entries))
        self.automaton.make_automaton()
        self.empty = not by_phrase
        self.inside = regex.compile(WORD)

    def find(self, text: str) -> Iterator[tuple[str, str, int, int]]:
        low, word = folded(text), self.inside.match
        for last, (length, entries) in () if self.empty else self.automaton.iter(low):
            start, stop = last - length + 1, last + 1
            if (start and word(text[start - 1])) or (stop < len(text) and word(text[stop])):
                continue
            for rule, phrase in entries:
                yield rule, phrase, start, stop
        for rule, phrase, pattern in self.patterns:
            for hit in pattern.finditer(text):
                yield rule, phrase, hit.start(), hit.end()


def evidence(df: DataFrame, key: str, text: str, phrases: Iterable[tuple[str, str]]) -> DataFrame:
    """(key, rule, phrase, start, stop): code points, end exclusive. `phrases` are (rule, phrase) pairs."""
    table = sorted(set(phrases))
    if len(table) > MOST_PHRASES:
        raise ValueError(f"{len(table)} phrases; a table holds at most {MOST_PHRASES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(table)
        for batch in batches:
            keys, rows = batch["key"].to_pylist(), []
            for at, body in zip(keys, batch["text"]):
                rows += [(at, *hit) for hit in matcher.find(body.as_py())]
            if rows:
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[1]), pa.array(columns[2]),
                     pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.int32())],
                    names=["key", "rule", "phrase", "start", "stop"])

    rows = df.filter(F.col(text).isNotNull()).select(
        F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, FIELDS)
