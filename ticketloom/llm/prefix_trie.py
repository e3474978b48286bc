"""A trie of conversation prefixes with subtree totals by parallel tree contraction.

A node is a distinct sequence of first d turns (role, text); the textless root has d = 0. The members of
a node are the conversations that begin with it. A node's name is (smallest member, depth).

Prefixes are told apart by running sums: every turn's SHA-256 and depth give four 64-bit numbers, and a
prefix is its depth and the four sums. Sums run over ranges of a conversation, so one of any length
is spread over all tasks.

Subtree totals come from contraction rounds. A round rakes all leaves into their parents (an aggregate
by parent, combined before its shuffle) and compresses chains: a node with one child that lies lower in
priority than its parent and its child is spliced out, its own total moving to the edge below it. The
priority is the number of trailing zeros of the depth, then a hash, so half of a plain chain goes in each
round, and the rounds grow with the logarithm of the nodes. Every round is one written table, smaller by a
constant factor than the one before. Expansion goes back round by round: a spliced node's total is what
it held plus its child's, which a later round has settled.

Conversations sort by turn, null first; equal turns by role, then by the SHA-256 of (role, text). A null
role or text is empty. Rows without conv_id take no part. Equal rows are turns of their own. A conversation
without turns ends at the root. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ticketloom.llm.mixing import word_count
from ticketloom.llm.ranges import in_ranges, with_totals
from ticketloom.llm.staging import staged
from ticketloom.session import scratch_path

SUMS = ["s0", "s1", "s2", "s3"]
#: Ids of a block share all but their last bits: a block holds at most 2**14 of them.
BLOCK_BITS = 14
LIVE, SPLICED, RAKED = 0, 1, 2


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, words, part): every turn and its place from 1, written in ranges."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), digest.alias("digest"),
        word_count(text).alias("words"), F.monotonically_increasing_id().alias("row"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "digest", "row"]
    parts = in_ranges(staged(rows, "turns"), *order)
    placed = with_totals(parts, ["conv_id"], "part", order[1:], {"before": F.lit(1).cast("long")})
    return placed.select("conv_id", (F.col("before") + 1).alias("pos"), "digest", "words", "part")


def rebuilt(rows: DataFrame, stride: int = 20, most: int = 4) -> DataFrame:
    """(conv_id, depth, digest, words, part): conversations that share their first turns.

    Conversation c takes the first h turns of conversation c - c % stride and then its own after its
    first h, with h = crc32(decimal c) % most. Every conversation lends at most (most - 1) turns to at most
    2 * stride others. Part -1 holds what was lent.
    """
    c = F.col("conv_id")
    lent = F.crc32(c.cast("string").cast("binary")) % F.lit(most)
    heads = rows.filter(F.col("pos") < most).select(
        F.col("conv_id").alias("lender"), "pos", "digest", "words")
    given = heads.groupBy("lender").agg(F.count(F.lit(1)).alias("most"))
    every = rows.select("conv_id").distinct().select(
        "conv_id", (c - c % F.lit(stride)).alias("lender"), lent.alias("h"))
    known = staged(every.join(given, "lender", "left").select(
        "conv_id", "lender", "h", F.least("h", F.coalesce("most", F.lit(0))).alias("got")), "conversations")
    first = known.join(heads, "lender").filter(F.col("pos") <= F.col("h")).select(
        "conv_id", F.col("pos").alias("depth"), "digest", "words", F.lit(-1).alias("part"))
    own = rows.join(known, "conv_id").filter(F.col("pos") > F.col("h")).select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("got")).alias("depth"), "digest", "words", "part")
    root = known.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit("").alias("digest"),
                        F.lit(0).cast("long").alias("words"), F.lit(-1).alias("part"))
    return first.unionByName(own).unionByName(root)


def _name(depth: Column, sums: list[Column]) -> Column:
    return F.sha2(F.concat_ws(",", depth.cast("string"), *[s.cast("string") for s in sums]), 256)


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, words, key, parent_key, is_end): every prefix of every conversation."""
    rows = staged(rows, "rebuilt")
    marks = {s: F.when(F.col("depth") > 0, F.xxhash64(F.lit(i), "digest", "depth")).otherwise(
        F.lit(0).cast("long")).cast("decimal(38,0)") for i, s in enumerate(SUMS)}
    marked = rows.withColumns({f"m{s}": mark for s, mark in marks.items()})
    before = with_totals(marked, ["conv_id"], "part", ["depth"], {s: F.col(f"m{s}") for s in SUMS})
    ends = rows.groupBy("conv_id").agg(F.max("depth").alias("last"))
    past = [F.col(s) for s in SUMS]
    upto = [F.col(s) + F.col(f"m{s}") for s in SUMS]
    named = before.select(
        "conv_id", "depth", "words", _name(F.col("depth"), upto).alias("key"),
        F.when(F.col("depth") > 0, _name(F.col("depth") - 1, past)).alias("parent_key"))
    return staged(named.join(ends, "conv_id").withColumn(
        "is_end", F.col("depth") == F.col("last")).drop("last"), "prefixes")


def nodes(found: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, key, n_convs, n_children, words), one row per node."""
    each = staged(found.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("words").alias("words"),
        F.max("parent_key").alias("parent_key"), F.count(F.lit(1)).alias("n_convs")), "distinct")
    children = each.filter(F.col("parent_key").isNotNull()).groupBy("parent_key").agg(
        F.count(F.lit(1)).alias("n_children"))
    named = each.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    with_parent = each.join(named, "parent_key", "left").drop("parent_key")
    return staged(with_parent.join(
        children.withColumnRenamed("parent_key", "key"), "key", "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0)).cast("long")), "nodes")


ROUND = ("conv_id long, depth long, up_conv long, up_depth long, kids long, total array<long>, edge array<long>, "
         "child_conv long, child_depth long, child_edge array<long>, what int")


def _plus(*arrays: str) -> Column:
    """Sums of arrays of two longs."""
    return F.array(*[sum((F.get(a, F.lit(i)) for a in arrays[1:]), F.get(arrays[0], F.lit(i))) for i in (0, 1)])


def _priority(depth: str) -> Column:
    """Trailing zeros first: the lowest bit set of a depth; the root's is above all others."""
    low = F.col(depth).bitwiseAND(-F.col(depth))
    return F.struct(F.when(F.col(depth) == 0, F.lit((1 << 63) - 1)).otherwise(low), F.xxhash64(depth))


def _contract(live: DataFrame) -> DataFrame:
    """One round: leaves leave with their totals, the others learn of theirs, chains lose nodes."""
    leaf = F.col("kids") == 0
    told = live.filter(F.col("up_conv").isNotNull()).groupBy("up_conv", "up_depth").agg(
        *[F.sum(F.when(leaf, F.get("total", F.lit(i)) + F.get("edge", F.lit(i))).otherwise(0)).alias(f"raked{i}")
          for i in (0, 1)],
        F.count_if(~leaf).alias("left"),
        F.min(F.when(~leaf, F.struct("conv_id", "depth", "edge"))).alias("child"))
    told = told.select(F.col("up_conv").alias("conv_id"), F.col("up_depth").alias("depth"),
                       F.array("raked0", "raked1").alias("raked"), "left", "child")
    inner = live.filter(~leaf).join(told, ["conv_id", "depth"]).select(
        "conv_id", "depth", "up_conv", "up_depth", F.col("left").alias("kids"),
        _plus("total", "raked").alias("total"), "edge", F.col("child.conv_id").alias("child_conv"),
        F.col("child.depth").alias("child_depth"), F.col("child.edge").alias("child_edge"))
    least = (_priority("depth") < _priority("up_depth")) & (_priority("depth") < _priority("child_depth"))
    spliced = F.col("up_conv").isNotNull() & (F.col("kids") == 1) & least
    inner = inner.withColumn("what", F.when(spliced, SPLICED).otherwise(LIVE))
    gone = live.filter(leaf).withColumns({
        "child_conv": F.lit(None).cast("long"), "child_depth": F.lit(None).cast("long"),
        "child_edge": F.lit(None).cast("array<long>"), "what": F.lit(RAKED)})
    return inner.unionByName(gone)


def _after(table: DataFrame) -> DataFrame:
    """The tree after a round: children of spliced nodes hang from their grandparents."""
    live = table.filter(F.col("what") == LIVE).select(
        "conv_id", "depth", "up_conv", "up_depth", "kids", "total", "edge")
    moves = table.filter(F.col("what") == SPLICED).select(
        F.col("child_conv").alias("conv_id"), F.col("child_depth").alias("depth"),
        F.col("up_conv").alias("new_conv"), F.col("up_depth").alias("new_depth"),
        _plus("total", "edge").alias("more"))
    moved = F.col("new_conv").isNotNull()
    return live.join(moves, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", F.coalesce("new_conv", "up_conv").alias("up_conv"),
        F.coalesce("new_depth", "up_depth").alias("up_depth"), "kids", "total",
        F.when(moved, _plus("edge", "more")).otherwise(F.col("edge")).alias("edge"))


def subtree_totals(tree: DataFrame, first: str, second: str) -> DataFrame:
    """(conv_id, depth, first, second): sums of two long columns over every node's subtree.

    `tree` has conv_id, depth, up_conv, up_depth (null for the root) and kids, the number of children.
    """
    spark = tree.sparkSession
    live = tree.select(
        "conv_id", "depth", "up_conv", "up_depth", "kids",
        F.array(first, second).alias("total"), F.array(F.lit(0), F.lit(0)).cast("array<long>").alias("edge"))

    def stored(path: str, what: int) -> DataFrame:
        return spark.read.schema(ROUND).parquet(path).filter(F.col("what") == what)

    def raked(path: str) -> DataFrame:
        return stored(path, RAKED).select("conv_id", "depth", "total")

    rounds = []
    while True:
        path, left = scratch_path(spark, "contracted"), Observation()
        done = _contract(live).observe(left, F.count_if(F.col("what") != RAKED).alias("n"))
        done.write.partitionBy("what").parquet(path)
        rounds.append(path)
        if not left.get["n"]:
            break
        live = _after(spark.read.schema(ROUND).parquet(path))
    settled = raked(rounds[-1])
    for path in reversed(rounds[:-1]):
        # the nodes settled so far are those alive after the round, so the joins shrink like the rounds
        child = settled.select(F.col("conv_id").alias("child_conv"), F.col("depth").alias("child_depth"),
                               F.col("total").alias("below"))
        back = stored(path, SPLICED).join(child, ["child_conv", "child_depth"]).select(
            "conv_id", "depth", _plus("total", "child_edge", "below").alias("total"))
        settled = settled.unionByName(staged(back, "expanded")).unionByName(raked(path))
    return settled.select("conv_id", "depth", F.get("total", F.lit(0)).alias(first),
                          F.get("total", F.lit(1)).alias(second))


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's blocks in order; a key's rows are neighbours and only its state is held."""
    key, state = None, None

    def row():
        return pa.RecordBatch.from_pydict({"key": done[0], "ends_sha256": done[1]})

    for batch in batches:
        done = ([], [])
        for this, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if this != key:
                if state:
                    done[0].append(key)
                    done[1].append(state.hexdigest())
                key, state = this, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done[0]:
            yield row()
    if state:
        done = ([key], [state.hexdigest()])
        yield row()


def ends(found: DataFrame) -> DataFrame:
    """(key, ends_sha256): the hash of the ids, ascending and comma-joined, that end at a node.

    A hash has to see its bytes in order. Ids are joined to blocks first, spread over all tasks; then one
    task at a time reads a node's blocks, holding a batch of them.
    """
    last = found.filter("is_end")
    blocks = last.groupBy("key", F.shiftright("conv_id", BLOCK_BITS).alias("block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
        .alias("ids"))
    spread = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = blocks.repartition(spread, "key").sortWithinPartitions("key", "block")
    return ordered.select("key", "ids").mapInArrow(_hash_ends, "key string, ends_sha256 string")


def trie(rows: DataFrame) -> DataFrame:
    """The trie of conversations given as (conv_id, depth, digest, words, part); see `digest`."""
    found = prefixes(rows)
    all_nodes = nodes(found)
    tree = all_nodes.select(
        "conv_id", "depth", F.col("parent_conv_id").alias("up_conv"),
        F.when(F.col("parent_conv_id").isNotNull(), F.col("depth") - 1).alias("up_depth"),
        F.col("n_children").alias("kids"), (F.col("n_children") == 0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    totals = subtree_totals(tree, "n_leaves", "saved_tokens")
    return all_nodes.join(totals, ["conv_id", "depth"]).join(ends(found), "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def digest(conversations: DataFrame) -> DataFrame:
    return trie(rebuilt(turns(conversations)))


#: crc32 bit by bit; a node is the list of its turns; a total is summed over every node's ancestors.
ORACLE = r"""
WITH o AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS lender,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
          lambda x: CAST(ord(x) AS BIGINT))),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda v, z: xor(v // 2, 3988292384 * (v % 2)))), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM o)
), k AS (
  SELECT c.*, least(h, (SELECT count(*) FROM o WHERE o.conv_id = lender)) AS got FROM c
), r AS (
  SELECT k.conv_id, o.pos AS depth, role, text FROM k JOIN o ON o.conv_id = lender AND pos <= h
  UNION ALL
  SELECT k.conv_id, pos - h + got, role, text FROM k JOIN o ON o.conv_id = k.conv_id AND pos > h
  UNION ALL
  SELECT conv_id, 0, NULL, NULL FROM k
), p AS (
  SELECT conv_id, depth, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS words,
    CAST(list({'r': role, 't': text}) OVER w AS VARCHAR) AS key,
    depth = max(depth) OVER (PARTITION BY conv_id) AS is_end
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY depth)
), n AS (
  SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256
  FROM p GROUP BY depth, key
), u AS (
  SELECT n.*, q.key AS parent_key, m.conv_id AS parent_conv_id
  FROM n LEFT JOIN p q ON q.conv_id = n.conv_id AND q.depth = n.depth - 1
  LEFT JOIN n m ON m.depth = q.depth AND m.key = q.key
), f AS (
  SELECT u.*, (SELECT count(*) FROM u x WHERE x.depth = u.depth + 1 AND x.parent_key = u.key) AS n_children FROM u
), t AS (
  SELECT p.depth, p.key, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * f.words) AS saved_tokens
  FROM f JOIN p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY p.depth, p.key
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM f JOIN t USING (depth, key)
"""
