"""Weighted rendezvous hashing of stable record keys.

Every shard draws a number from the hash of (key, shard); the shard with the smallest draw takes
the row. A key's draws do not depend on the other shards, so one more shard only takes rows for
itself and a removed one only gives its own away. Weights scale the chance of a shard. The place of
a row needs no shuffle; only the optional dense slots do.

Nulls: a null key is hashed as a key of its own, so all such rows share a shard; a null text has
size 0 bytes and the checksum of the empty text. Repeated rows keep one slot each. Ties between
draws go to the smaller shard. Empty tables give empty results.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that a slot range aims at; a range is numbered by one task.
RANGE_ROWS = 100_000


def draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) from the hash of (key, shard)."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the smallest exponential draw of rate `weights[shard]`."""
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive, one per shard")
    if len(set(weights)) == 1:  # equal rates: the largest draw has the smallest exponential
        scores = [-draw(key, i) for i in range(len(weights))]
    else:
        scores = [-F.log(draw(key, i)) / F.lit(float(w)) for i, w in enumerate(weights)]
    pairs = [F.struct(s.alias("score"), F.lit(i).alias("shard")) for i, s in enumerate(scores)]
    return (F.least(*pairs) if len(pairs) > 1 else pairs[0])["shard"]


def with_shards(df: DataFrame, key: str, weights: Sequence[float],
                column: str = "shard") -> DataFrame:
    """`df` with its shard; every other column stays as it is."""
    return df.withColumn(column, shard_of(F.col(key), weights))


def with_slots(df: DataFrame, shard: str, by: Sequence[str], column: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without gaps, in the order of a hash of `by`.

    Shards are cut into hash ranges of about RANGE_ROWS different rows, so no task holds a shard.
    Equal rows are counted before the shuffle and given out again afterwards in pieces.
    """
    spark, names = df.sparkSession, list(df.columns)
    own = f"_{uuid.uuid4().hex[:8]}"
    n, piece, mark, base, inner = (f"{own}{x}" for x in ("n", "piece", "mark", "base", "inner"))
    counted = df.groupBy(*names).agg(F.count(F.lit(1)).alias(n))
    ranges = df.select(F.ceil(F.count(F.lit(1)) / F.lit(RANGE_ROWS)).alias("r"))
    ranges = max(1, int(ranges.first()["r"]))
    hashed = F.xxhash64(*[F.col(c) for c in by])
    pieces = counted.withColumn(mark, hashed).withColumn(
        piece, F.floor(F.shiftrightunsigned(F.col(mark), 32) * F.lit(ranges) / F.lit(1 << 32)))
    totals = pieces.groupBy(shard, piece).agg(F.sum(n).alias("total"))
    before = Window.partitionBy(shard).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        F.col(shard).alias(f"{own}s"), F.col(piece).alias(f"{own}p"),
        F.coalesce(F.sum("total").over(before), F.lit(0)).alias(base))
    order = Window.partitionBy(shard, piece).orderBy(mark, *names).rowsBetween(
        Window.unboundedPreceding, -1)
    placed = pieces.withColumn(inner, F.coalesce(F.sum(n).over(order), F.lit(0))).join(
        bases, F.col(shard).eqNullSafe(F.col(f"{own}s")) & (F.col(piece) == F.col(f"{own}p")))
    first = F.col(base) + F.col(inner)
    blocks = F.sequence(F.lit(0), F.floor((F.col(n) - 1) / F.lit(RANGE_ROWS)))
    # a row that repeats often leaves its task in blocks before its copies are given out
    single = placed.filter(F.col(n) == 1).select(*names, first.cast("long").alias(column))
    many = placed.filter(F.col(n) > 1).select(
        *names, first.alias(base), n, F.explode(blocks).alias(piece)).repartition(
        int(spark.conf.get("spark.sql.shuffle.partitions")), *names, piece)
    low = F.col(piece) * RANGE_ROWS
    high = F.least(low + F.lit(RANGE_ROWS), F.col(n)) - 1
    copies = many.select(*names, base, F.explode(F.sequence(low, high)).alias(inner)).select(
        *names, (F.col(base) + F.col(inner)).cast("long").alias(column))
    return single.unionByName(copies)
