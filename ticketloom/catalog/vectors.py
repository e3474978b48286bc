"""Vector table, retrieval and prompt queries."""

from pyspark.sql import functions as F

from ticketloom import fixed_values as fv
from ticketloom.catalog import sql
from ticketloom.catalog.messages import labeled_tickets, short_tickets
from ticketloom.catalog.recipes import query_calls, raw_messages, table
from ticketloom.functions import prompts as pr
from ticketloom.functions.rules import label_table
from ticketloom.operators import cells as ce
from ticketloom.operators import encoding as en
from ticketloom.operators import similarity as sim
from ticketloom.operators.payload import with_chunks
from ticketloom.plans import answering
from ticketloom.plans.population import populate
from ticketloom.plans.preparation import clean_tickets
from ticketloom.session import scratch_path
from ticketloom.sources import vector_table as vt
from ticketloom.sources.tables import staged

DIM = 64


def stored_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("point_id"), F.col("embedding").alias("vector"), "label"
    )


def search(spark, sf_dir, **options):
    """Every vector against all others."""
    stored = stored_vectors(spark, sf_dir)
    return sim.top_k(stored, stored, DIM, query_id="point_id", skip_same_id=True, **options)


def cosine_topk(spark, sf_dir):
    return search(spark, sf_dir).select(
        "query_id", "rank", "hit_id", F.round("similarity", 4).alias("similarity")
    )


def cosine_topk_blocks(spark, sf_dir):
    """The same search with both sides cut into many pieces, as for large query sets."""
    return search(spark, sf_dir, group_queries=150, block_rows=200).select(
        "query_id", "rank", "hit_id", F.round("similarity", 4).alias("similarity"))


def low_similarity(spark, sf_dir):
    stored = stored_vectors(spark, sf_dir)
    hits = search(spark, sf_dir, floor=0.45)
    found = sim.low_similarity(stored.withColumnRenamed("point_id", "query_id"), hits, threshold=0.5)
    return found.withColumn("best_similarity", F.round("best_similarity", 4))


def hit_lists(spark, sf_dir):
    """Hits as one array per query, shown as a list of ids with rounded percentages."""
    rows = search(spark, sf_dir)
    lists = sim.hit_lists(rows, ("rank", "hit_id", "similarity"))
    shown = F.transform("hits", lambda h: F.concat(
        h["hit_id"].cast("string"), F.lit(":"),
        sim.similarity_percent(h["similarity"]).cast("string"), F.lit("%")))
    return lists.select("query_id", F.array_join(shown, " ").alias("hits"))


def normalised(spark, sf_dir):
    """Scaled copies of the stored vectors brought back to length 1."""
    scaled = stored_vectors(spark, sf_dir).withColumn(
        "vector", F.transform("vector", lambda x: x.cast("double") * 3)
    )
    unit = scaled.select("point_id", sim.unit_vector(F.col("vector")).alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return unit.select("point_id", F.size("v").alias("dim"), F.round(norm, 4).alias("norm"))


def upsert(spark, sf_dir):
    """Vectors stored, then a batch with relabelled, repeated and new points merged in."""
    path = scratch_path(spark, "vectors")
    stored = stored_vectors(spark, sf_dir)
    vt.create(spark, path, stored.schema)
    vt.upsert(spark, path, stored, shard_points=100)
    changed = stored.filter(F.col("label") < 4)
    batch = (
        changed.withColumn("label", F.col("label") + 100).withColumn("version", F.lit(1))
        .unionByName(changed.withColumn("label", F.col("label") + 200)
                     .withColumn("version", F.lit(2)))
        .unionByName(stored.withColumn("point_id", F.col("point_id") + 1_000_000)
                     .withColumn("version", F.lit(1)))
    )
    vt.upsert(spark, path, batch, "version", shard_points=100)
    return vt.read(spark, path).select("point_id", "label")


def point_count(spark, sf_dir):
    path = scratch_path(spark, "counted")
    vt.upsert(spark, path, stored_vectors(spark, sf_dir))
    return vt.read(spark, path).agg(F.count("*").alias("points"))


def chunk_texts(spark, sf_dir):
    return with_chunks(short_tickets(spark, sf_dir)).select("tweet_id", "chunk_text")


def embed_hash(spark, sf_dir):
    chunks = with_chunks(short_tickets(spark, sf_dir))
    encoder = en.fit_hashing_encoder(chunks)
    return en.encode(encoder, chunks).select("tweet_id", "vector")


def embed_documents(spark, sf_dir):
    """Whole documents encoded by the hashing encoder."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return en.fit_and_encode(docs, "text")


def filled_table(spark, sf_dir):
    path = scratch_path(spark, "tickets")
    labeled = staged(label_table(clean_tickets(raw_messages(spark, sf_dir))), "labeled")
    _, encoder = populate(labeled, path)
    return vt.read(spark, path), encoder


def populate_tickets(spark, sf_dir):
    points, _ = filled_table(spark, sf_dir)
    return points.select("point_id", F.col("payload.tweet_id").alias("tweet_id"),
                         F.col("payload.chunk_text").alias("chunk_text"),
                         F.size("vector").alias("dim"))


def populate_once(spark, sf_dir):
    """Points after a first fill and after a second one, which leaves a filled table alone."""
    path = scratch_path(spark, "once")
    labeled = staged(labeled_tickets(spark, sf_dir), "labeled-once")
    first, encoder = populate(labeled, path)
    second, _ = populate(labeled.filter(F.col("tweet_id") % 2 == 0), path, encoder)
    return vt.read(spark, path).agg(F.count("*").alias("points")).select(
        "points", F.lit(first).cast("long").alias("first_fill"),
        F.lit(second).cast("long").alias("second_fill"))


def retrieve_by_text(spark, sf_dir):
    """The most similar tickets of every clean ticket's text, itself included."""
    vectors, encoder = filled_table(spark, sf_dir)
    asked = vectors.select(F.col("payload.tweet_id").alias("query_id"),
                           F.col("payload.chunk_text").alias("query"))
    return answering.retrieve(asked, vectors, encoder, fv.VECTOR_DIM)


def responses(spark, sf_dir):
    """Response rows for every query of the log: hits, prompts, weak-context mark, label."""
    vectors, encoder = filled_table(spark, sf_dir)
    accepted = answering.screen(query_calls(spark, sf_dir).select("query_id", "query")).accepted
    return answering.respond_all(accepted, vectors, encoder, fv.VECTOR_DIM)


def cell_topk(spark, sf_dir):
    """Search by cell: 16 cells on disk, as many probed as a recall of 0.9 takes."""
    stored = stored_vectors(spark, sf_dir)
    model = ce.fit_cells(stored, 16)
    table_ = ce.write_cells(ce.with_cell(model, stored), scratch_path(spark, "cells"))
    probes = ce.probes_for(stored, table_, model, DIM, query_id="point_id", skip_same_id=True)
    hits = ce.cell_top_k(stored, table_, model, DIM, probes=probes, query_id="point_id",
                         skip_same_id=True)
    return hits.select("query_id", "rank", "hit_id")


def cell_topk_all(spark, sf_dir):
    """Search by cell with every cell probed: the exact result."""
    stored = stored_vectors(spark, sf_dir)
    model = ce.fit_cells(stored, 8)
    table_ = ce.write_cells(ce.with_cell(model, stored), scratch_path(spark, "cells"))
    hits = ce.cell_top_k(stored, table_, model, DIM, probes=8, query_id="point_id",
                         skip_same_id=True)
    return hits.select("query_id", "rank", "hit_id")


def cell_recall(spark, sf_dir):
    return ce.recall(search(spark, sf_dir), cell_topk(spark, sf_dir))


def ticket_hits(spark, sf_dir):
    """Every labelled ticket as the one hit of its own text, with a derived similarity."""
    labeled = labeled_tickets(spark, sf_dir)
    texts = labeled.select(
        F.col("tweet_id"), "airline", "priority", "score",
        F.col("text"),
        F.when(F.col("tweet_id") % 2 == 0, F.concat(F.lit("see "), F.col("text")))
        .otherwise(F.lit("")).alias("agent_response"),
        ((F.col("tweet_id") % 100) / 100).alias("similarity"),
    )
    return texts.select(
        "tweet_id", F.col("text").alias("query"),
        F.array(F.struct("airline", "priority", "similarity", "text", "agent_response"))
        .alias("hits"),
    )


def context_block(spark, sf_dir):
    return ticket_hits(spark, sf_dir).select(
        "tweet_id", pr.context_text(F.col("hits")).alias("context")
    )


def answer_prompts(spark, sf_dir):
    hits = ticket_hits(spark, sf_dir)
    some = F.when(F.col("tweet_id") % 3 > 0, F.col("hits"))
    return hits.select("tweet_id", pr.answer_prompt(F.col("query"), some).alias("prompt"))


def label_prompts(spark, sf_dir):
    return short_tickets(spark, sf_dir).select(
        "tweet_id", pr.label_prompt(F.col("text")).alias("prompt")
    )


def guard_prompts(spark, sf_dir):
    """Guard prompts over whole documents; the prompt itself takes 400 characters of a query."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", pr.guard_prompt(F.col("text")).alias("prompt")
    )


QUERIES = {f.__name__: f for f in (
    cosine_topk, cosine_topk_blocks, low_similarity, hit_lists, normalised, upsert, point_count,
    chunk_texts, embed_hash, embed_documents, populate_tickets, populate_once, retrieve_by_text, responses,
    cell_topk, cell_topk_all, cell_recall, context_block, answer_prompts, label_prompts,
    guard_prompts,
)}


def topk(floor: float = fv.SIMILARITY_FLOOR) -> str:
    return f"""pairs as (select q.vec_id as query_id, c.vec_id as hit_id,
      round(list_cosine_similarity(q.embedding::double[], c.embedding::double[]), 10) as sim
    from embeddings q join embeddings c on q.vec_id <> c.vec_id),
  hits as (select *, row_number() over (partition by query_id order by sim desc, hit_id) as rank
    from pairs where sim >= {floor} qualify rank <= {fv.TOP_K})"""


def filled(template: str, **values: str) -> str:
    """A prompt template as a SQL concatenation."""
    text = "'" + template.replace("'", "''") + "'"
    for name, expression in values.items():
        text = text.replace("{" + name + "}", f"' || {expression} || '")
    return text


def block() -> str:
    number = ("regexp_replace(cast(cast(round((tweet_id % 100) / 100::double, 4) as decimal(12,4))"
              " as varchar), '(\\.\\d+?)0+$', '\\1')")
    return (f"'[' || airline || ' | ' || priority || ' | similarity=' || {number}"
            f" || ']\n' || 'Customer: ' || text || case when tweet_id % 2 = 0"
            f" then '\n' || 'Resolution: see ' || text else '' end")


ORACLES = {
    "cosine_topk": f"""with {topk()} select query_id, rank::integer as rank, hit_id,
        round(sim, 4) as similarity from hits""",
    "cosine_topk_blocks": f"""with {topk()} select query_id, rank::integer as rank, hit_id,
        round(sim, 4) as similarity from hits""",
    "cell_topk_all": f"with {topk()} select query_id, rank::integer as rank, hit_id from hits",
    "low_similarity": f"""with {topk(0.45)}, best as (select query_id, count(*) as n,
          max(sim) as sim from hits group by query_id)
        select vec_id as query_id, coalesce(n, 0) as retrieved_count,
          round(sim, 4) as best_similarity, coalesce(sim < 0.5, true) as low_similarity
        from embeddings left join best on query_id = vec_id""",
    "hit_lists": f"""with {topk()} select query_id, string_agg(hit_id || ':' ||
          cast(round(100 * sim) as integer) || '%', ' ' order by rank) as hits
        from hits group by query_id""",
    "normalised": """select vec_id as point_id, len(embedding)::integer as dim,
        1.0::double as norm from embeddings""",
    "upsert": """select vec_id as point_id, label + case when label < 4 then 200 else 0 end as label
          from embeddings
        union all select vec_id + 1000000, label from embeddings""",
    "point_count": "select count(*) as points from embeddings",
    "chunk_texts": f"""with {sql.CLEANED}
        select tweet_id, '[' || airline || '] ' || text as chunk_text from firsts""",
    "populate_tickets": f"""with {sql.CLEANED}
        select row_number() over (order by tweet_id) - 1 as point_id, tweet_id,
          '[' || airline || '] ' || text as chunk_text, {fv.VECTOR_DIM} as dim from firsts""",
    "populate_once": f"""with {sql.CLEANED} select count(*) as points, count(*) as first_fill,
        count(*) as second_fill from firsts""",
    "context_block": f"with {sql.LABELED_ONLY} select tweet_id, {block()} as context from labeled",
    "answer_prompts": f"""with {sql.LABELED_ONLY} select tweet_id, case when tweet_id % 3 > 0
          then {filled(fv.CONTEXT_PROMPT, context=block(), query='text')}
          else {filled(fv.NO_CONTEXT_PROMPT, query='text')} end as prompt from labeled""",
    "label_prompts": f"""with {sql.CLEANED}
        select tweet_id, {filled(fv.LABEL_PROMPT, query='text')} as prompt from firsts""",
    "guard_prompts": f"""select doc_id, {filled(fv.GUARD_PROMPT,
        query=f"substr(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, {fv.GUARD_QUERY_CHARS})")}
        as prompt from documents""",
}
