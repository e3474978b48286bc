"""Running totals over groups of any size: the order is cut into ranges, one task a range.

A window over a whole group runs in one task. Here rows are dealt out by ranges of their order, the
ranges are written with their numbers, and only totals per group and range are added up in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ticketloom.llm.staging import staged

#: Rows that a range of a hash or of a counter aims at.
RANGE_ROWS = 100_000


def in_ranges(df: DataFrame, *order: str | Column, part: str = "part") -> DataFrame:
    """`df` written in ranges of `order`, with the number of each row's range."""
    return staged(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")


def with_totals(df: DataFrame, by: Sequence[str], part: str, order: Sequence[str | Column],
                totals: dict[str, Column]) -> DataFrame:
    """Add, per name, the total of a column over the earlier rows of the group, this one left out.

    `part` rises with `order` within every group; totals of an empty past are 0.
    """
    own = {name: f"_own_{i}" for i, name in enumerate(totals)}
    df = df.withColumns({own[name]: value for name, value in totals.items()})
    past = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = df.groupBy(*by, part).agg(*[F.sum(c).alias(c) for c in own.values()])
    names = [*by, part]
    bases = bases.select(
        *[F.col(c).alias(f"_key_{i}") for i, c in enumerate(names)],
        *[F.coalesce(F.sum(c).over(past), F.lit(0)).alias(f"_base{c}") for c in own.values()])
    here = Window.partitionBy(*names).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = df.withColumns({f"_here{c}": F.coalesce(F.sum(c).over(here), F.lit(0)) for c in own.values()})
    same = [F.col(c).eqNullSafe(F.col(f"_key_{i}")) for i, c in enumerate(names)]
    joined = placed.join(bases, same)
    kept = [c for c in df.columns if c not in own.values()]
    return joined.select(*kept, *[(F.col(f"_base{c}") + F.col(f"_here{c}")).alias(name)
                                  for name, c in own.items()])


def hash_part(digest: Column, rows: int) -> Column:
    """The range, of about RANGE_ROWS rows, of a hexadecimal digest; it rises with the digest."""
    ranges = max(1, -(-rows // RANGE_ROWS))
    head = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(head * F.lit(ranges) / F.lit(1 << 32))
