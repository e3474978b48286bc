"""Mix sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

Every source gets a target: its share, by weight, of a budget. No target passes `most` times its source's
size; what is cut off is shared again by weight. A source is a shuffled stream of its documents, in as
many passes as its target asks for, each shuffled anew, cut into blocks of equally many tokens.

A schedule of slots says which source comes next: slot i takes the point i * golden ratio modulo 1, mapped
through the cumulative targets. Slots of a source are ranked, and rank r joins block r. Such points hit
every source in proportion to within a few slots; slots past a source's last block are left out, and
blocks that got no slot follow at the end. So each source gives exactly its rounded target.

Nulls: a null source is a source of its own, the last; a null size counts as 0, a null id is an id like
any other. Documents of size 0 give no block. Equal rows (id, source, size) are told apart by a copy
number, so they spread like others. Sources sort by code point. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.ranges import RANGE_ROWS, hash_part, in_ranges, with_totals
from ticketloom.llm.staging import staged

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK = 512
#: The odd number next to 2**31 over the golden ratio: its multiples modulo 2**31 visit every point once.
GOLDEN, POINT_BITS = 1327217885, 31


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sized(df: DataFrame, doc_id: str, source: str, size: Column) -> DataFrame:
    """(doc_id, source, size, copy), written once; equal rows differ in their copy number."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                     F.coalesce(size, F.lit(0)).cast("long").alias("size"))
    names = rows.columns
    counted = staged(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n")), "documents")
    single = counted.filter("n = 1").select(*names, F.lit(0).cast("long").alias("copy"))
    # a row that repeats often leaves its task in blocks before its copies are given out
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RANGE_ROWS))
    many = counted.filter("n > 1").select(*names, "n", F.explode(blocks).alias("block")).repartition(
        int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *names, "block")
    low = F.col("block") * RANGE_ROWS
    high = F.least(low + F.lit(RANGE_ROWS), F.col("n")) - 1
    return single.unionByName(many.select(*names, F.explode(F.sequence(low, high)).alias("copy")))


def targets(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
            most: int = MOST) -> DataFrame:
    """(source, source_size, place, weight, target, need, low), written once.

    `need` is the rounded target, `low` the needs of the sources before. With l the level at which
    sum(least(most * size, weight * l)) is the budget, a target is least(most * size, weight * l). Taken
    in the order of most * size / weight, the level the rest would have rises while sources are below
    their cap and falls after, so l is the greatest of these.
    """
    sizes = in_ranges(docs.groupBy("source").agg(F.sum("size").alias("source_size")),
                      F.col("source").isNull(), F.col("source"))
    by_name = with_totals(sizes, [], "part", [F.col("source").asc_nulls_last()],
                          {"place": F.lit(1).cast("long")})
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    weighed = by_name.withColumn(
        "weight", F.get(cycle, F.pmod("place", F.lit(len(weights))).cast("int")).cast("long")).withColumn(
        "ratio", F.col("source_size") * F.lit(float(most)) / F.col("weight"))
    by_ratio = in_ranges(weighed.drop("part"), "ratio", "place")
    total, weight = by_ratio.agg(F.sum("source_size"), F.sum("weight")).first()
    if total is None:
        level = 0.0
    else:
        past = with_totals(by_ratio, [], "part", ["ratio", "place"],
                           {"caps": F.col("source_size") * F.lit(most), "weights": F.col("weight")})
        rest = (F.lit(share * total) - F.col("caps")) / (F.lit(weight) - F.col("weights"))
        level = past.agg(F.max(rest)).first()[0]
    target = F.least(F.col("source_size") * F.lit(float(most)), F.col("weight") * F.lit(float(level)))
    needs = weighed.withColumn("target", target).withColumn(
        "need", F.floor(F.col("target") + F.lit(0.5)).cast("long"))
    lows = with_totals(needs, [], "part", ["place"], {"low": F.col("need")})
    return staged(lows.select("source", "source_size", "place", "weight", "target", "need", "low"), "targets")


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, place, rank): which block of which source comes next, in the order of `slot`."""
    spark = sources.sparkSession
    n, total = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum("need"), F.lit(0))).first()
    slots, cells = -(-total // block), max(10, (4 * n).bit_length())
    # a grid of cells brings each point to the few sources it may hit
    reach = [F.greatest(F.lit(0), F.least(F.lit((1 << cells) - 1), F.floor(x) + d)).cast("long")
             for x, d in ((F.col("low") * F.lit((1 << cells) / max(total, 1)), -1),
                          ((F.col("low") + F.col("need")) * F.lit((1 << cells) / max(total, 1)), 1))]
    grid = sources.filter("need > 0").select(
        "place", "need", F.col("low").cast("double").alias("from"),
        (F.col("low") + F.col("need")).cast("double").alias("to"), F.explode(F.sequence(*reach)).alias("cell"))
    period = 1 << POINT_BITS
    point = (F.pmod("slot", F.lit(period)) * F.lit(GOLDEN)) % F.lit(period)
    points = spark.range(slots).withColumnRenamed("id", "slot").withColumn("point", point).select(
        "slot", F.shiftright("point", POINT_BITS - cells).alias("cell"),
        (F.col("point") * F.lit(total / period)).alias("at"))
    hits = points.join(grid, "cell").filter((F.col("at") >= F.col("from")) & (F.col("at") < F.col("to")))
    hits = hits.select("slot", "place", "need", F.floor(F.col("slot") / RANGE_ROWS).alias("part"))
    ranked = with_totals(hits, ["place"], "part", ["slot"], {"rank": F.lit(1).cast("long")})
    used = ranked.filter(F.col("rank") * block < F.col("need")).select("slot", "place", "rank")
    counts = hits.groupBy("place").agg(F.count(F.lit(1)).alias("have"))
    last = F.ceil(F.col("need") / block)
    late = sources.join(counts, "place", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    late = late.filter(F.col("have") < last).select(
        "place", F.explode(F.sequence("have", last - 1)).alias("rank"))
    late = late.select((F.lit(slots) + F.col("rank") * n + F.col("place")).alias("slot"), "place", "rank")
    return used.unionByName(late)


def pieces(docs: DataFrame, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, copy, size, place, epoch, block, first, n): stretches of documents that fill the blocks."""
    known = sources.select(F.col("source").alias("of"), "source_size", "place", "need")
    rows = docs.count()
    passes = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("need") / F.col("source_size")) - 1)
    mark = F.md5(F.concat_ws(":", F.col("epoch").cast("string"), F.coalesce(
        F.col("doc_id").cast("string"), F.lit("null")), F.col("copy").cast("string")))
    stream = docs.filter("size > 0").join(known, F.col("source").eqNullSafe(F.col("of"))).filter(
        "need > 0").withColumn("epoch", F.explode(passes)).withColumn("mark", mark).withColumn(
        "part", hash_part(F.col("mark"), rows))
    order = ["mark", "doc_id", "size", "copy"]
    stream = with_totals(stream.drop("of"), ["place", "epoch"], "part", order, {"before": F.col("size")})
    start = F.col("epoch") * F.col("source_size") + F.col("before")
    stream = stream.withColumn("start", start).filter("start < need").withColumn(
        "stop", F.least(F.col("start") + F.col("size"), F.col("need")))
    cut = stream.withColumn("block", F.explode(F.sequence(
        F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block))))
    low = F.greatest("start", F.col("block") * block)
    high = F.least("stop", (F.col("block") + 1) * block)
    return cut.select("doc_id", "copy", "size", "place", "epoch", "block",
                      (low - F.col("start")).alias("first"), (high - low).alias("n"))


def mix(docs: DataFrame, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix itself, in the order of (slot, at): tokens first .. first + n - 1 of a document's copy."""
    slots = schedule(sources, block).select("slot", "place", F.col("rank").alias("block"))
    return pieces(docs, sources, block).join(slots, ["place", "block"])


def digest(documents: DataFrame) -> DataFrame:
    docs = sized(documents, "doc_id", "source", word_count(F.col("text")))
    sources = targets(docs)
    known = sources.select(F.col("source").alias("of"), "source_size", "target", "place")
    keys = ["place", "doc_id", "size", "copy"]
    every = docs.join(known, F.col("source").eqNullSafe(F.col("of"))).select(
        *keys, "source_size", "target", F.lit(0).cast("long").alias("n"))
    taken = mix(docs, sources).select(
        *keys, F.lit(None).cast("long").alias("source_size"), F.lit(None).cast("double").alias("target"), "n")
    return every.unionByName(taken).groupBy(*keys).agg(
        F.max("source_size").alias("source_size"), F.max("target").alias("target"),
        F.sum("n").alias("taken")).select("doc_id", "size", "source_size", "target", "taken")


#: Rows that are equal in doc_id, source and size take copy numbers; which is which can't be told apart.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, size, row_number() OVER (PARTITION BY doc_id, source, size) - 1 AS copy
  FROM (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
        FROM documents)
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, 2.0::DOUBLE * source_size / weight AS ratio FROM s
), l AS (
  SELECT max((1.5::DOUBLE * total - caps) / (all_weights - weights)) AS level FROM (
    SELECT sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weights,
      coalesce(sum(2 * source_size) OVER w, 0) AS caps, coalesce(sum(weight) OVER w, 0) AS weights
    FROM r WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
), t AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, weight * level) AS target FROM r, l
), n AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS need FROM t
), e AS (
  SELECT d.*, n.source_size, target, need, epoch, epoch * n.source_size + coalesce(sum(size) OVER (
      PARTITION BY d.source, epoch
      ORDER BY md5(concat(epoch, ':', coalesce(CAST(doc_id AS VARCHAR), 'null'), ':', copy)), doc_id, size, copy
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source, range(2) AS p(epoch)
)
SELECT doc_id, size, source_size, target,
  CAST(sum(greatest(0, least(start + size, need) - start)) AS BIGINT) AS taken
FROM e GROUP BY doc_id, source, size, copy, source_size, target
"""
