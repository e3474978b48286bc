"""Streaming deduplication that does not forget: the first row of a key ever, by a keyed state processor.

Watermark deduplication drops its state after the delay, so a copy that comes later passes again. Here an
entry of a map state per key holds the time of the first row; later rows are dropped and counted, those more
than `delay` after it (which a watermark would have let pass) apart. State lives in RocksDB on disk. With
`forget_days`, state that was not written for so long expires, if "ever" costs too much.

Keys are handled in BUCKETS, a call of Python each: a call per key cost more than its rows. A key may hold a
third of all rows, so the first processor deals a key by salt over up to `salts` buckets and lets one row
through per bucket; the second, dealt by the key alone, sees at most `salts` rows of a key and the counts.
Which row of a micro-batch is first is decided by event time, then id.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 1024
#: A row with an id is a first one; a row without is a count of copies since the last micro-batch.
COLUMNS = ["key", "row_id", "event_ms", "copies", "late"]
#: Between the processors `is_row` tells them apart: numbers beside nulls would become floats in pandas.
FIELDS = "key string, row_id long, event_ms long, copies long, late long, is_row boolean"


class First(StatefulProcessor):
    """One row per key of a bucket, ever; the others as counts."""

    def __init__(self, delay_ms: int, forget_ms: int | None):
        self.delay_ms, self.forget_ms = delay_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("firsts", "key string", "event_ms long", self.forget_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        numbers: dict[str, int] = {}
        parts = []
        for part in rows:  # a text is kept once per key
            own, names = pd.factorize(part["key"])
            number = np.array([numbers.setdefault(name, len(numbers)) for name in names], np.int64)
            parts.append((number[own], *(part[c].to_numpy() for c in (*COLUMNS[1:], "is_row"))))
        if not numbers:
            return
        of, row_id, event_ms, copies, late, is_row = (np.concatenate(p) for p in zip(*parts))
        names, n = list(numbers), len(numbers)
        total, beyond = np.zeros(n, np.int64), np.zeros(n, np.int64)
        np.add.at(total, of, copies)
        np.add.at(beyond, of, late)

        first, known, best = np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, np.int64)
        if self.seen.exists():
            for i, name in enumerate(names):
                found = self.seen.getValue((name,))
                if found is not None:
                    first[i], known[i] = found[0], True
        of, row_id, event_ms = of[is_row], row_id[is_row], event_ms[is_row]
        order = np.lexsort((row_id, event_ms, of))
        has, at = np.unique(of[order], return_index=True)
        fresh = ~known[has]
        passed, head = has[fresh], order[at[fresh]]
        first[passed], best[passed], known[passed] = event_ms[head], row_id[head], True
        for i in passed:
            self.seen.updateValue((names[i],), (int(first[i]),))
        total += np.bincount(of, minlength=n)
        total[passed] -= 1
        beyond += np.bincount(of[event_ms > first[of] + self.delay_ms], minlength=n)

        counted = np.flatnonzero(total)
        told = np.concatenate([passed, counted])
        new = np.arange(len(told)) < len(passed)
        if len(told):
            yield pd.DataFrame({
                "key": [names[i] for i in told], "row_id": np.where(new, best[told], 0),
                "event_ms": first[told], "copies": np.where(new, 0, total[told]),
                "late": np.where(new, 0, beyond[told]), "is_row": new})

    def close(self) -> None:
        pass


def first_ever(rows: DataFrame, key: str, row_id: str, event_time: str, delay_days: int = 30,
               forget_days: int | None = None, salts: int = 16) -> DataFrame:
    """key, row_id, event_ms, copies, late of a stream, in append mode.

    Its session must use RocksDB state, see `with_rocksdb`. Rows without key, id or time take no part.
    """
    day = 24 * 3600 * 1000
    forget = None if forget_days is None else forget_days * day
    named = rows.select(
        F.col(key).cast("string").alias("key"), F.col(row_id).cast("long").alias("row_id"),
        F.unix_millis(F.col(event_time).cast("timestamp")).alias("event_ms"),
        F.lit(0).cast("long").alias("copies"), F.lit(0).cast("long").alias("late"), F.lit(True).alias("is_row"))
    named = named.filter(F.col("key").isNotNull() & F.col("row_id").isNotNull() & F.col("event_ms").isNotNull())
    salt = F.pmod(F.xxhash64("row_id"), F.lit(salts))

    def firsts(rows: DataFrame, *dealt_by) -> DataFrame:
        bucket = F.pmod(F.xxhash64(*dealt_by), F.lit(BUCKETS)).alias("bucket")
        return rows.select("*", bucket).groupBy("bucket").transformWithStateInPandas(
            First(delay_ms=delay_days * day, forget_ms=forget), FIELDS, "append",
            "ProcessingTime" if forget else "None")

    found = firsts(firsts(named, F.col("key"), salt), F.col("key"))
    return found.select("key", F.when(F.col("is_row"), F.col("row_id")).alias("row_id"), *COLUMNS[2:])


def with_rocksdb(spark):
    """A session of the same application whose streams keep state in RocksDB; others are not changed."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        session.conf.set(name, spark.conf.get(name))
    return session
