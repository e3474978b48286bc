"""Profiling queries over derived messages and the shared text tables."""

from pyspark.sql import functions as F

from ticketloom import fixed_values as fv
from ticketloom.catalog import sql
from ticketloom.catalog.messages import features_of_tickets, labeled_tickets
from ticketloom.catalog.recipes import raw_messages, table
from ticketloom.operators import profiling as pf
from ticketloom.operators import routing as ro
from ticketloom.operators.ranking import exact_quantiles

FLAGS = ("has_critical_signal", "has_urgency_keywords", "has_delay", "has_profanity",
         "has_sarcasm")
BINARY = tuple(f for f in fv.FEATURES if f.startswith("has_"))


def rounded(df, digits=6):
    """Round the floating columns: sums of fractions differ in their last bits by order."""
    return df.select(*[
        F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else f.name
        for f in df.schema.fields
    ])


def handle_counts(spark, sf_dir):
    return ro.handle_counts(raw_messages(spark, sf_dir))


def other_handles(spark, sf_dir):
    return ro.other_handles(raw_messages(spark, sf_dir), min_count=20)


def first_mentions(spark, sf_dir):
    return ro.first_mentions(raw_messages(spark, sf_dir))


def null_profile(spark, sf_dir):
    return pf.null_profile(raw_messages(spark, sf_dir))


def direction_split(spark, sf_dir):
    return pf.direction_split(raw_messages(spark, sf_dir))


def length_by_direction(spark, sf_dir):
    return pf.length_by_direction(raw_messages(spark, sf_dir))


def length_histogram(spark, sf_dir):
    """Clipped length of documents in 50 bins per language."""
    docs = table(spark, sf_dir, "documents").select("lang", F.length("text").alias("size"))
    return pf.histogram(docs, "size", 50, cap=pf.LENGTH_CAP, by=["lang"])


def message_length_histogram(spark, sf_dir):
    """Clipped length of inbound messages in 50 bins."""
    inbound = ro.inbound_rows(raw_messages(spark, sf_dir))
    return pf.histogram(inbound, F.length("text"), 50, cap=pf.LENGTH_CAP).drop("density")


def priority_length_density(spark, sf_dir):
    labeled = labeled_tickets(spark, sf_dir).withColumn("size", F.length("text"))
    return pf.histogram(labeled, "size", 50, cap=pf.LENGTH_CAP, by=["priority"])


def score_histogram(spark, sf_dir):
    return pf.histogram(labeled_tickets(spark, sf_dir), "score", 11, bounds=(-0.5, 10.5),
                        by=["priority"])


def score_bands(spark, sf_dir):
    return pf.score_bands(labeled_tickets(spark, sf_dir))


def priority_share(spark, sf_dir):
    return pf.priority_summary(labeled_tickets(spark, sf_dir))


def class_balance(spark, sf_dir):
    return pf.class_balance(features_of_tickets(spark, sf_dir))


def score_by_priority(spark, sf_dir):
    return pf.group_summary(labeled_tickets(spark, sf_dir), "priority", "score")


def score_boxes(spark, sf_dir):
    return pf.box_plot(labeled_tickets(spark, sf_dir), "priority", "score")


def document_boxes(spark, sf_dir):
    return pf.box_plot(table(spark, sf_dir, "documents"), "source", "n_chars")


def numeric_summary(spark, sf_dir):
    return rounded(pf.numeric_summary(features_of_tickets(spark, sf_dir), fv.FEATURES))


def score_quartiles(spark, sf_dir):
    labeled = labeled_tickets(spark, sf_dir)
    return exact_quantiles(labeled, ["score"], pf.QUARTILES, by=["airline"]).drop("metric")


def value_quartiles(spark, sf_dir):
    """Quartiles of a continuous column per event type."""
    events = table(spark, sf_dir, "events")
    return exact_quantiles(events, ["value"], pf.QUARTILES, by=["event_type"]).drop("metric")


def firing_rates(spark, sf_dir):
    return pf.firing_rates(labeled_tickets(spark, sf_dir), FLAGS)


def feature_firing_rates(spark, sf_dir):
    table_ = features_of_tickets(spark, sf_dir)
    return pf.firing_rates(table_, BINARY, F.col("is_urgent") == 1)


def binary_columns(spark, sf_dir):
    return pf.binary_columns(features_of_tickets(spark, sf_dir), fv.FEATURES)


def minmax_mean_gap(spark, sf_dir):
    return rounded(pf.class_mean_gaps(features_of_tickets(spark, sf_dir)))


def p99_clip(spark, sf_dir):
    return pf.clipped_at_p99(features_of_tickets(spark, sf_dir), "text_length")


QUERIES = {f.__name__: f for f in (
    handle_counts, other_handles, first_mentions, null_profile, direction_split,
    length_by_direction, length_histogram, message_length_histogram, priority_length_density,
    score_histogram, score_bands, priority_share, class_balance, score_by_priority, score_boxes,
    document_boxes, numeric_summary, score_quartiles, value_quartiles, firing_rates,
    feature_firing_rates, binary_columns, minmax_mean_gap, p99_clip,
)}


def five(value: str) -> str:
    return f"""count({value}) as count, {sql.percentile(value, 0.0)} as min,
      {sql.percentile(value, 0.25)} as q1, {sql.percentile(value, 0.5)} as median,
      {sql.percentile(value, 0.75)} as q3, {sql.percentile(value, 1.0)} as max"""


def unfolded(source: str, columns, cells) -> str:
    return " union all ".join(f"select {cells(c)} from {source}" for c in columns)


def boxes(source: str, group: str, value: str) -> str:
    return f"""five as (select {group}, {five(value)} from {source} group by {group}),
      fenced as (select s.{group}, s.{value}::double as v,
          s.{value} >= q1 - 1.5 * (q3 - q1) and s.{value} <= q3 + 1.5 * (q3 - q1) as within
        from {source} s join five using ({group}))
      select f.*, w.whisker_low, w.whisker_high, w.outliers from five f join (
        select {group}, min(v) filter (where within) as whisker_low,
          max(v) filter (where within) as whisker_high,
          count(*) filter (where not within) as outliers from fenced group by {group}) w
        using ({group})"""


def clipped_bins(source: str, group: str, value: str, bins: int, cap: str) -> str:
    """Histogram per group between the group's own extremes."""
    return f"""clipped as (select {group}, least({value}, {cap})::double as v from {source}
          where {value} is not null),
      ranges as (select {group}, min(v) as low, (max(v) - min(v)) / {bins}::double as width,
          count(*) as n from clipped group by {group}),
      binned as (select c.{group}, r.low, r.width, r.n, case when width > 0
          then least(cast(floor((v - low) / width) as integer), {bins - 1}) else 0 end as bin
        from clipped c join ranges r using ({group})),
      bars as (select {group}, bin, low + bin * width as bin_low, count(*) as rows,
          case when width > 0 then count(*) / (n * width) end as density
        from binned group by {group}, bin, low, width, n)"""


ORACLES = {
    "handle_counts": f"""with {sql.ROUTED} select airline as handle, count(*) as count
        from inbound_rows where airline is not null group by airline""",
    "other_handles": f"""with {sql.ROUTED} select airline as handle, count(*) as count
        from inbound_rows where airline is not null and lower(airline) not in ({sql.BRANDS})
        group by airline having count(*) >= 20 order by count desc, handle limit 25""",
    "first_mentions": f"""with {sql.MESSAGES_SQL},
        m as (select nullif(regexp_extract(text, '^@([A-Za-z0-9_]+)', 1), '') as handle
          from raw where inbound)
        select handle, count(*) as count, lower(handle) in ({sql.BRANDS}) as is_target
        from m where handle is not null group by handle order by count desc, handle limit 30""",
    "null_profile": f"""with {sql.MESSAGES_SQL}, n as ({unfolded('raw',
        ('tweet_id', 'author_id', 'inbound', 'created_at', 'text', 'in_response_to_tweet_id'),
        lambda c: f"'{c}' as column, count(*) - count({c}) as nulls, count(*) as rows")})
        select "column", nulls, 100e0 * nulls / rows as null_pct from n where nulls > 0""",
    "direction_split": f"""with {sql.MESSAGES_SQL},
        d as (select case when inbound then 'inbound' else 'outbound' end as direction,
          count(*) as messages from raw where inbound is not null group by 1)
        select direction, messages, 100e0 * messages / (select sum(messages) from d)
          as share_pct from d""",
    "length_by_direction": f"""with {sql.MESSAGES_SQL},
        s as (select case when inbound then 'inbound' else 'outbound' end as direction,
          length(text) as n from raw where text is not null)
        select direction, count(*) as count, avg(n) as mean, {sql.percentile('n', 0.5)} as median,
          max(n)::double as max from s group by direction""",
    "length_histogram": f"""with sized as (select lang, length(text) as size from documents),
        {clipped_bins('sized', 'lang', 'size', 50, '280')} select * from bars""",
    "message_length_histogram": f"""with {sql.ROUTED},
        sized as (select 1 as one, length(text) as size from inbound_rows),
        {clipped_bins('sized', 'one', 'size', 50, '280')} select bin, bin_low, rows from bars""",
    "priority_length_density": f"""with {sql.LABELED_ONLY},
        sized as (select priority, length(text) as size from labeled),
        {clipped_bins('sized', 'priority', 'size', 50, '280')} select * from bars""",
    "score_histogram": f"""with {sql.LABELED_ONLY},
        sizes as (select priority, count(*) as n from labeled group by priority)
        select priority, score as bin, -0.5::double + score as bin_low, count(*) as rows,
          count(*) / n::double as density
        from labeled join sizes using (priority) group by priority, score, n""",
    "score_bands": f"""with {sql.LABELED_ONLY}
        select case when score >= 8 then 'critical' when score = 0 then 'silent' else 'middle' end
          as band, count(*) as tickets from labeled group by 1""",
    "priority_share": f"""with {sql.LABELED_ONLY},
        c as (select count(*) filter (where priority = 'URGENT') as urgent,
          count(*) filter (where priority = 'NORMAL') as normal, count(*) as tickets,
          avg(score) as mean_score from labeled)
        select *, 100e0 * urgent / tickets as urgent_pct, normal / urgent as normal_per_urgent
        from c""",
    "class_balance": f"""with {sql.FEATURED}
        select is_urgent, count(*) as rows,
          100e0 * count(*) / (select count(*) from featured) as share_pct
        from featured group by is_urgent""",
    "score_by_priority": f"""with {sql.LABELED_ONLY}
        select priority, count(*) as count, avg(score) as mean,
          {sql.percentile('score', 0.5)} as median, max(score)::double as max
        from labeled group by priority""",
    "score_boxes": f"with {sql.LABELED_ONLY}, {boxes('labeled', 'priority', 'score')}",
    "document_boxes": f"with {boxes('documents', 'source', 'n_chars')}",
    "numeric_summary": f"""with {sql.FEATURED}, {unfolded('featured', fv.FEATURES, lambda c:
        f"'{c}' as metric, {five(c)}, round(avg({c}), 6) as mean, "
        f"round(stddev_samp({c}), 6) as std")
        .replace("select", "rows as (select", 1)})
        select metric, count, mean, std, round(min, 6) as min, round(q1, 6) as q1,
          round(median, 6) as median, round(q3, 6) as q3, round(max, 6) as max from rows""",
    "score_quartiles": f"""with {sql.LABELED_ONLY}
        select airline, {five('score')} from labeled group by airline""",
    "value_quartiles": f"select event_type, {five('value')} from events group by event_type",
    "firing_rates": f"""with {sql.LABELED_ONLY} {unfolded('labeled', FLAGS, lambda c:
        f"'{c}' as signal, 100e0 * avg({c}::int) filter (where priority = 'URGENT') as urgent_pct,"
        f" 100e0 * avg({c}::int) filter (where priority = 'NORMAL') as normal_pct")}""",
    "feature_firing_rates": f"""with {sql.FEATURED} {unfolded('featured', BINARY, lambda c:
        f"'{c}' as signal, 100e0 * avg({c}) filter (where is_urgent = 1) as urgent_pct,"
        f" 100e0 * avg({c}) filter (where is_urgent = 0) as normal_pct")}""",
    "binary_columns": f"""with {sql.FEATURED} {unfolded('featured', fv.FEATURES, lambda c:
        f"'{c}' as column, bool_and({c} in (0, 1)) as is_binary")}""",
    "minmax_mean_gap": f"""with {sql.FEATURED}, {unfolded('featured', fv.FEATURES, lambda c:
        f"'{c}' as feature, case when max({c}) > min({c}) then (avg({c}) filter "
        f"(where is_urgent = 1) - avg({c}) filter (where is_urgent = 0)) / (max({c}) - min({c})) "
        f"else 0 end as gap").replace("select", "rows as (select", 1)})
        select feature, round(gap, 6) as gap from rows""",
    "p99_clip": f"""with {sql.FEATURED},
        cut as (select {sql.percentile('text_length', 0.99)} as p99 from featured),
        sized as (select is_urgent, text_length, p99 from featured, cut),
        {clipped_bins('sized', 'is_urgent', 'text_length', 40, 'p99')}
        select is_urgent, bin, rows, density from bars""",
}
