"""Licence scan: parts of texts against licence templates by the Dice coefficient of word bigrams.

Text and templates are reduced to lower-case words; a region is a run of a document's words, or of its
whole lines if asked, and its bigrams, across lines, are a multiset. Dice is twice the shared bigrams
over the bigrams of both sides. With T bigrams in a template, only regions of T t / (2 - t) to
T (2 - t) / t bigrams can reach t; a document must hold t T / (2 - t) of the template's bigrams at all to
be looked at, and a region begins and ends with a bigram of the template, or a line that holds some, as
others only dilute it. All bounds are exact.

Each template is reported once per document with its best region (ties: the first, then the
shortest): its lines and its words, numbered from 0, the last included. Nulls, empty texts and texts
without two words match nothing; so do templates of fewer than two words. Repeated rows give repeated
results. A document is searched by one task.
"""

from __future__ import annotations

from collections import Counter
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketloom.llm import arrays
from ticketloom.llm.licence_texts import TEMPLATES

THRESHOLD = 0.8

MATCH = T.StructType([
    T.StructField("licence", T.StringType()), T.StructField("dice", T.DoubleType()),
    T.StructField("first_line", T.IntegerType()), T.StructField("last_line", T.IntegerType()),
    T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType())])
_ARROW = pa.list_(pa.struct([("licence", pa.string()), ("dice", pa.float64()),
                             ("first_line", pa.int32()), ("last_line", pa.int32()),
                             ("first_word", pa.int64()), ("last_word", pa.int64())]))


def _bigrams(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    return arrays.WordTable(data, np.array([0, len(data)]), arrays.WORDS).grams(2)[0]


class Templates:
    """Bigram multisets of the templates and one sorted table of all their bigrams."""

    def __init__(self, texts: dict[str, str], threshold: float):
        if not 0 < threshold <= 1:
            raise ValueError("the threshold lies in (0, 1]")
        self.threshold = threshold
        self.names = sorted(texts)
        self.bags = [Counter(_bigrams(texts[n]).tolist()) for n in self.names]
        self.sizes = [sum(b.values()) for b in self.bags]
        known = sorted(set().union(*self.bags)) if self.bags else []
        self.known = np.array(known, dtype=np.uint64)
        self.member = np.zeros((len(known), len(self.bags)), dtype=bool)
        for t, bag in enumerate(self.bags):
            self.member[np.searchsorted(self.known, np.array(sorted(bag), dtype=np.uint64)), t] = True
        # the smallest region that can match has t T / (2 - t) bigrams, all of them shared
        self.least = np.array([max(1, ceil(s * threshold / (2 - threshold) - 1e-9)) for s in self.sizes])

    def span(self, t: int, grams: np.ndarray, hits: np.ndarray):
        """Best region of template t between any two words: (dice, first word, last word) or None."""
        size, bag, limit = self.sizes[t], self.bags[t], self.threshold
        most = floor(size * (2 - limit) / limit + 1e-9)
        at = np.flatnonzero(hits)
        known, kind = np.unique(grams[at], return_inverse=True)
        wanted = np.array([bag[g] for g in known.tolist()])
        order = np.argsort(kind, kind="stable")
        number = np.empty(len(at), dtype=np.int64)  # of a bigram among its equals
        number[order] = np.arange(len(at)) - np.searchsorted(kind[order], kind[order])
        ends = np.searchsorted(at, at + most)
        # a region of s shared bigrams has s bigrams at least
        shared = np.minimum(ends - np.arange(len(at)), size)
        bounds = 2 * shared / (shared + size)
        passed, best = np.zeros(len(known), dtype=np.int64), None
        for i, (end, bound) in enumerate(zip(ends.tolist(), bounds.tolist())):
            if bound >= limit - 1e-9 and (best is None or bound > best[0]):
                own = kind[i:end]
                n = at[i:end] - at[i] + 1
                dice = 2 * np.cumsum(number[i:end] - passed[own] < wanted[own]) / (n + size)
                j = int(np.argmax(dice))
                if dice[j] >= limit - 1e-9 and (best is None or dice[j] > best[0]):
                    best = (float(dice[j]), int(at[i]), int(at[i + j]) + 1)
            passed[kind[i]] += 1
        return best

    def regions(self, t: int, grams: np.ndarray, hits: np.ndarray, firsts: np.ndarray, lasts: np.ndarray):
        """Best region of template t: (dice, first line, last line) or None.

        `grams` are the document's bigrams by first word, `hits` marks those of the template; line i
        holds the words firsts[i] to lasts[i] - 1.
        """
        size, bag, limit = self.sizes[t], self.bags[t], self.threshold
        most = floor(size * (2 - limit) / limit + 1e-9)
        before = np.append(0, np.cumsum(hits))
        # a bigram may begin on a line and end on the next: it makes both worth starting or ending at
        touched = np.flatnonzero(hits)
        words = np.unique(np.concatenate([touched, touched + 1]))
        lines = np.unique(np.searchsorted(lasts, words, side="right"))
        best = None
        for i, line in enumerate(lines):
            start = firsts[line]
            for other in lines[i:]:
                n = lasts[other] - start - 1
                if n > most:
                    break
                if n < self.least[t]:
                    continue
                bound = min(before[lasts[other] - 1] - before[start], size)
                if 2 * bound < limit * (n + size) - 1e-9 or (best and 2 * bound / (n + size) <= best[0]):
                    continue
                part = Counter(grams[start:lasts[other] - 1].tolist())
                dice = 2 * sum(min(c, bag[g]) for g, c in part.items() if g in bag) / (n + size)
                if dice >= limit - 1e-9 and (best is None or dice > best[0]):
                    best = (dice, int(line), int(other))
        return best

    def scan(self, data: np.ndarray, offsets: np.ndarray,
             whole_lines: bool = False) -> list[list[tuple[str, float, int, int, int, int]]]:
        """Matches of each text of a slice."""
        words = arrays.WordTable(data, offsets, arrays.WORDS)
        n_rows, out = len(words.counts), [[] for _ in range(len(words.counts))]
        grams, first, row = words.grams(2)
        if not len(self.known) or not len(grams):
            return out
        at = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
        hit = np.flatnonzero(self.known[at] == grams)
        member = self.member[at[hit]]
        for t in range(len(self.names)):
            counts = np.bincount(row[hit][member[:, t]], minlength=n_rows)
            for r in np.flatnonzero(counts >= self.least[t]) if self.sizes[t] else ():
                a, b = np.searchsorted(first, words.rows[r]), np.searchsorted(first, words.rows[r + 1])
                # line borders of the row as numbers of its words
                text = data[offsets[r]:offsets[r + 1]]
                breaks = np.append(np.flatnonzero(text == 10), len(text)) + offsets[r]
                lasts = np.searchsorted(words.starts, breaks) - words.rows[r]
                firsts = np.append(0, lasts[:-1])
                own = grams[a:b]
                known = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
                hits = (self.known[known] == own) & self.member[known, t]
                if whole_lines:
                    found = self.regions(t, own, hits, firsts, lasts)
                    places = found and (*found[1:], firsts[found[1]], lasts[found[2]] - 1)
                else:
                    found = self.span(t, own, hits)
                    places = found and (*np.searchsorted(lasts, found[1:], side="right"), *found[1:])
                if found:
                    out[r].append((self.names[t], round(found[0], 9), *map(int, places)))
        return out


def with_licences(docs: DataFrame, text: str = "text", templates: dict[str, str] | None = None,
                  threshold: float = THRESHOLD, column: str = "licences",
                  whole_lines: bool = True) -> DataFrame:
    """`docs` with an array of matches by template name; one pass without a shuffle.

    Without `whole_lines` a region may begin and end inside a line.
    """
    kept = [c for c in docs.columns if c != column]
    own = [f"c{i}" for i in range(len(kept))]
    known = Templates(TEMPLATES if templates is None else templates, threshold)
    keys = MATCH.names

    def scan(batches):
        for part in arrays.slices(batches, "_text"):
            found = known.scan(*arrays.text_bytes(part.column("_text")), whole_lines)
            yield pa.RecordBatch.from_arrays(
                [part.column(i) for i in range(len(kept))]
                + [pa.array([[dict(zip(keys, m)) for m in f] for f in found], _ARROW)],
                names=own + ["_matches"])

    rows = docs.select(*(F.col(c).alias(o) for c, o in zip(kept, own)),
                       F.col(text).cast("string").alias("_text"))
    fields = [T.StructField(o, docs.schema[c].dataType) for c, o in zip(kept, own)]
    found = rows.mapInArrow(scan, T.StructType([*fields, T.StructField("_matches", T.ArrayType(MATCH))]))
    return found.select(*(F.col(o).alias(c) for c, o in zip(kept, own)), F.col("_matches").alias(column))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: its best licence, that one's Dice, and all matches as a string.

    A match is licence:first_line:last_line:first_word:last_word.
    """
    found = with_licences(docs.select("doc_id", "text"), whole_lines=False).drop("text")
    best = F.array_max(F.transform("licences", lambda m: F.struct(
        m["dice"].alias("dice"), m["licence"].alias("licence"))))
    shown = F.array_join(F.transform("licences", lambda m: F.concat_ws(
        ":", m["licence"], *(m[c].cast("string") for c in MATCH.names[2:]))), ",")
    return found.select("doc_id", F.size("licences").cast("long").alias("n_licences"),
                        best["licence"].alias("licence"), best["dice"].alias("dice"),
                        shown.alias("licences"))
