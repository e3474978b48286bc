"""Hash-table search, threshold joins, and vector tables with snapshots."""

from pyspark.sql import functions as F

from ticketloom import fixed_values as fv
from ticketloom.catalog import sql
from ticketloom.catalog.messages import labeled_tickets
from ticketloom.catalog.vectors import DIM, stored_vectors
from ticketloom.operators import cells as ce
from ticketloom.operators import lsh
from ticketloom.operators import similarity as sim
from ticketloom.operators import threshold as th
from ticketloom.operators.encoding import fit_hashing_encoder
from ticketloom.operators.payload import with_chunks
from ticketloom.plans import population
from ticketloom.session import scratch_path
from ticketloom.sources import snapshots
from ticketloom.sources.tables import staged

#: Searches ask with every row whose id this divides, against all rows.
EVERY = 50
HASHING = lsh.Hashing(DIM)


def asking(stored):
    return stored.filter(F.col("point_id") % EVERY == 0)


def hash_search(spark, sf_dir, hashing=HASHING, probes=None):
    stored = stored_vectors(spark, sf_dir)
    index = lsh.write_index(lsh.with_codes(stored, hashing), scratch_path(spark, "hashed"))
    options = {"query_id": "point_id", "skip_same_id": True}
    probes = probes or lsh.probes_for(asking(stored), stored, hashing, **options)
    return lsh.top_k(asking(stored), index, hashing, probes, **options)


def lsh_topk(spark, sf_dir):
    """Search by four hash tables, with as many probes as a recall of 0.9 takes."""
    return hash_search(spark, sf_dir).select("query_id", "rank", "hit_id")


def lsh_topk_all(spark, sf_dir):
    """The same with every bucket of two tables probed: the exact result."""
    hashing = lsh.Hashing(DIM, tables=2, bits=3)
    return hash_search(spark, sf_dir, hashing, 1 << hashing.bits).select("query_id", "rank", "hit_id")


def lsh_recall(spark, sf_dir):
    """The share of the exact hits that the search by hash tables finds."""
    stored = stored_vectors(spark, sf_dir)
    exact = sim.top_k(asking(stored), stored, DIM, query_id="point_id", skip_same_id=True)
    return ce.recall(exact, lsh_topk(spark, sf_dir))


def lsh_recall_ok(spark, sf_dir):
    return lsh_recall(spark, sf_dir).select(
        "exact_hits", (F.col("recall") >= lsh.LEAST_RECALL).alias("recall_ok"))


def joined_vectors(spark, sf_dir):
    """All vectors at least as similar as the floor to one whose id is divisible by EVERY."""
    stored = stored_vectors(spark, sf_dir)
    known = staged(th.classes(stored), "classes")
    asked = known.join(asking(stored).select("vector").distinct(), "vector", "left_semi")
    return th.similarity_join(asked, known, fv.SIMILARITY_FLOOR, th.fit_pivots(stored))


def similarity_join(spark, sf_dir):
    return joined_vectors(spark, sf_dir).pairs.select(
        "query_id", "hit_id", F.round("similarity", 4).alias("similarity"))


def similarity_join_report(spark, sf_dir):
    """Pairs of query and block that there are, and those that a bound skipped."""
    return joined_vectors(spark, sf_dir).report


def vector_classes(spark, sf_dir):
    """Every vector with the smallest id that holds the same one."""
    stored = stored_vectors(spark, sf_dir)
    return th.membership(stored, th.classes(stored))


def changed_table(spark, sf_dir):
    """A table of three snapshots after the empty one: filled, relabelled and grown, thinned."""
    path = scratch_path(spark, "snapshots")
    stored = stored_vectors(spark, sf_dir)
    snapshots.create(spark, path, stored.schema)
    snapshots.change(spark, path, stored, shard_points=100)
    some = stored.filter(F.col("label") < 4).withColumn("label", F.col("label") + 100)
    more = stored.withColumn("point_id", F.col("point_id") + 1_000_000)
    snapshots.change(spark, path, some.unionByName(more), shard_points=100)
    snapshots.change(spark, path, gone=stored.filter(F.col("point_id") % 3 == 0), shard_points=100)
    return path


def snapshot_rows(spark, sf_dir):
    return snapshots.read(spark, changed_table(spark, sf_dir)).select("point_id", "label")


def snapshot_history(spark, sf_dir):
    """What each snapshot holds, read back after the last change."""
    path = changed_table(spark, sf_dir)
    found = None
    for at in snapshots.history(spark, path):
        one = snapshots.load(spark, path, at).agg(
            F.lit(at.number).cast("long").alias("snapshot"), F.lit(at.parent).cast("long").alias("parent"),
            F.lit(at.points).cast("long").alias("logged"), F.count("*").alias("points"),
            F.coalesce(F.sum("label"), F.lit(0)).alias("labels"))
        found = one if found is None else found.unionByName(one)
    return found


def refreshed(spark, sf_dir):
    """Tickets stored, then brought up to a table with removed, changed and new ones."""
    labeled = staged(labeled_tickets(spark, sf_dir), "labeled")
    encoder = fit_hashing_encoder(with_chunks(labeled))
    path = scratch_path(spark, "refreshed")
    key = F.col("tweet_id")
    first = population.refresh(labeled.filter(key % 20 != 1), path, encoder)
    later = labeled.filter(key % 20 != 2).withColumn("text", F.when(
        key % 20 == 3, F.concat("text", F.lit(" again"))).otherwise(F.col("text")))
    return path, first, population.refresh(later, path, encoder)


def refresh_counts(spark, sf_dir):
    _, first, second = refreshed(spark, sf_dir)
    return spark.createDataFrame(
        [("first", *first.values()), ("second", *second.values())],
        "fill string, added long, changed long, removed long, kept long")


def refreshed_tickets(spark, sf_dir):
    """The stored chunks after the second fill; old tickets keep their point ids."""
    path, _, _ = refreshed(spark, sf_dir)
    return snapshots.read(spark, path).select(
        "point_id", F.col("payload.tweet_id").alias("tweet_id"),
        F.col("payload.chunk_text").alias("chunk_text"), F.size("vector").alias("dim"))


QUERIES = {f.__name__: f for f in (
    lsh_topk, lsh_topk_all, lsh_recall, lsh_recall_ok, similarity_join, similarity_join_report, vector_classes,
    snapshot_rows, snapshot_history, refresh_counts, refreshed_tickets,
)}

EXACT = f"""pairs as (select q.vec_id as query_id, c.vec_id as hit_id,
    round(list_cosine_similarity(q.embedding::double[], c.embedding::double[]), 10) as sim
  from embeddings q join embeddings c on q.vec_id <> c.vec_id where q.vec_id % {EVERY} = 0),
hits as (select *, row_number() over (partition by query_id order by sim desc, hit_id) as rank
  from pairs where sim >= {fv.SIMILARITY_FLOOR} qualify rank <= {fv.TOP_K})"""

ORACLES = {
    "lsh_topk_all": f"with {EXACT} select query_id, rank::integer as rank, hit_id from hits",
    "lsh_recall_ok": f"with {EXACT} select count(*) as exact_hits, true as recall_ok from hits",
    "similarity_join": f"""with classes as (select embedding, min(vec_id) as id,
          bool_or(vec_id % {EVERY} = 0) as asks from embeddings group by embedding)
        select q.id as query_id, c.id as hit_id,
          round(round(list_cosine_similarity(q.embedding::double[], c.embedding::double[]), 10), 4) as similarity
        from classes q join classes c on q.id <> c.id
        where q.asks and round(list_cosine_similarity(q.embedding::double[], c.embedding::double[]), 10)
          >= {fv.SIMILARITY_FLOOR}""",
    "vector_classes": """select vec_id as point_id, min(vec_id) over (partition by embedding) as class_id
        from embeddings""",
    "snapshot_rows": """select vec_id as point_id, label + case when label < 4 then 100 else 0 end as label
          from embeddings where vec_id % 3 <> 0
        union all select vec_id + 1000000, label from embeddings""",
    "snapshot_history": """with s as (select vec_id, label,
          label + case when label < 4 then 100 else 0 end as new from embeddings)
        select 0::bigint as snapshot, null::bigint as parent, 0::bigint as logged, 0::bigint as points,
          0::bigint as labels
        union all select 1, 0, count(*), count(*), sum(label)::bigint from s
        union all select 2, 1, 2 * count(*), 2 * count(*), sum(label + new)::bigint from s
        union all select 3, 2, count(*) + count(*) filter (vec_id % 3 <> 0),
          count(*) + count(*) filter (vec_id % 3 <> 0),
          (sum(label) + sum(new) filter (vec_id % 3 <> 0))::bigint from s""",
    "refresh_counts": f"""with {sql.CLEANED}
        select 'first' as fill, count(*) filter (tweet_id % 20 <> 1) as added, 0::bigint as changed,
          0::bigint as removed, 0::bigint as kept from firsts
        union all select 'second', count(*) filter (tweet_id % 20 = 1), count(*) filter (tweet_id % 20 = 3),
          count(*) filter (tweet_id % 20 = 2), count(*) filter (tweet_id % 20 not in (1, 2, 3)) from firsts""",
    "refreshed_tickets": f"""with {sql.CLEANED}, numbered as (
          select *, row_number() over (partition by tweet_id % 20 = 1 order by tweet_id) - 1
            + case when tweet_id % 20 = 1 then (select count(*) from firsts where tweet_id % 20 <> 1)
              else 0 end as point_id from firsts)
        select point_id, tweet_id, '[' || airline || '] ' || text
            || case when tweet_id % 20 = 3 then ' again' else '' end as chunk_text, {fv.VECTOR_DIM} as dim
        from numbered where tweet_id % 20 <> 2""",
}
