"""Splits, metrics and model jobs. Metric queries run on deterministic predictions."""

from pyspark.sql import functions as F

from ticketloom import fixed_values as fv
from ticketloom.catalog import sql
from ticketloom.catalog.messages import features_of_tickets, short_tickets
from ticketloom.catalog.recipes import table
from ticketloom.operators import evaluation as ev
from ticketloom.operators.profiling import split_sizes
from ticketloom.operators.ranking import stratified_split
from ticketloom.plans.training import (
    metrics_document, save_trained, score_texts, train,
)
from ticketloom.session import scratch_path
from ticketloom.sources.models import load_model
from ticketloom.sources.tables import staged

NAMES = ("by_length", "by_id", "by_both")

_TRAINED: dict[tuple[str, str], object] = {}


def trained(spark, sf_dir):
    """The whole training job over the features of a folder, run once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TRAINED:
        _TRAINED[key] = train(staged(features_of_tickets(spark, sf_dir), "features"))
    return _TRAINED[key]


def judged_documents(spark, sf_dir):
    """Three deterministic scorers of document quality: model, split, label, prediction, score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    joined = labels.join(docs, "doc_id")
    scores = {
        "by_length": (F.col("n_chars") % 1000) / 1000,
        "by_id": (F.col("doc_id") * 7 % 101) / 101,
        "by_both": ((F.col("n_chars") + F.col("doc_id")) % 20) / 20,
    }
    models = F.explode(F.array(*[
        F.struct(F.lit(n).alias("model"), scores[n].alias("score")) for n in NAMES
    ])).alias("_m")
    split = F.when(F.col("doc_id") % 2 == 0, "validation").otherwise("test")
    return joined.select("doc_id", "label", split.alias("split"), models).select(
        "_m.model", "split", "label", (F.col("_m.score") >= 0.3).cast("int").alias("prediction"),
        "_m.score",
    )


def confusion_matrix(spark, sf_dir):
    return ev.confusion(judged_documents(spark, sf_dir))


def auc_rank_sum(spark, sf_dir):
    return ev.auc(judged_documents(spark, sf_dir))


def binary_metrics(spark, sf_dir):
    return ev.binary_metrics(judged_documents(spark, sf_dir))


def metric_rows(spark, sf_dir):
    return ev.long_metrics(ev.binary_metrics(judged_documents(spark, sf_dir)))


def class_report(spark, sf_dir):
    return ev.classification_report(judged_documents(spark, sf_dir))


def model_selection(spark, sf_dir):
    return ev.compare_models(ev.binary_metrics(judged_documents(spark, sf_dir)), NAMES)


def ticket_split(spark, sf_dir):
    rows = staged(features_of_tickets(spark, sf_dir).select("tweet_id", "is_urgent"), "targets")
    return stratified_split(rows, "is_urgent", "tweet_id")


def document_split(spark, sf_dir):
    return stratified_split(table(spark, sf_dir, "labels").select("doc_id", "quality"),
                            "quality", "doc_id")


def split_counts(spark, sf_dir):
    return split_sizes(ticket_split(spark, sf_dir))


def train_compare(spark, sf_dir):
    """Split, fit and compare the three classifiers with the full protocol."""
    return train(staged(features_of_tickets(spark, sf_dir), "features")).comparison


def training_document(spark, sf_dir):
    return metrics_document(trained(spark, sf_dir))


def batch_score(spark, sf_dir):
    """Save the selected model, load it and score every clean ticket with the loaded one."""
    path = scratch_path(spark, "model")
    save_trained(trained(spark, sf_dir), path)
    model, names = load_model(spark, path)
    return score_texts(model, short_tickets(spark, sf_dir), "text", names or fv.FEATURES)


def unavailable_scores(spark, sf_dir):
    return score_texts(None, short_tickets(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    confusion_matrix, auc_rank_sum, binary_metrics, metric_rows, class_report, model_selection,
    ticket_split, document_split, split_counts, train_compare, training_document, batch_score,
    unavailable_scores,
)}

JUDGED = """base as (select l.doc_id, l.quality as label, d.n_chars,
    case when l.doc_id % 2 = 0 then 'validation' else 'test' end as split
  from labels l join documents d using (doc_id)),
scored as (
  select 'by_length' as model, split, label, (n_chars % 1000) / 1000::double as score from base
  union all select 'by_id', split, label, (doc_id * 7 % 101) / 101::double from base
  union all select 'by_both', split, label, ((n_chars + doc_id) % 20) / 20::double from base),
judged as (select *, cast(score >= 0.3 as integer) as prediction from scored),
counts as (select model, split,
    count(*) filter (where label = 1 and prediction = 1) as tp,
    count(*) filter (where label = 0 and prediction = 1) as fp,
    count(*) filter (where label = 1 and prediction = 0) as fn,
    count(*) filter (where label = 0 and prediction = 0) as tn
  from judged group by model, split),
ranked as (select model, split, label,
    rank() over (partition by model, split order by score)
      + (count(*) over (partition by model, split, score) - 1) / 2::double as place from judged),
areas as (select model, split,
    (sum(place) filter (where label = 1) - p * (p + 1) / 2::double) / (p * n) as roc_auc
  from ranked join (select model, split, count(*) filter (where label = 1) as p,
      count(*) filter (where label = 0) as n from judged group by model, split)
    using (model, split) group by model, split, p, n),
metrics as (select model, split, (tp + tn) / (tp + fp + fn + tn)::double as accuracy,
    2 * tp / (2 * tp + fp + fn)::double as f1, roc_auc
  from counts join areas using (model, split))"""

SPLIT = """ranked as (select *, row_number() over (partition by {label} order by
      md5('42:' || {key})) as nth, count(*) over (partition by {label}) as n from {source}),
cut as (select *, (n * 6 + 5) // 10 as train from ranked),
parts as (select {key}, {label}, case when nth <= train then 'train'
    when nth <= train + (n - train) // 2 then 'validation' else 'test' end as split from cut)"""

TICKET_SPLIT = SPLIT.format(label="is_urgent", key="tweet_id", source="featured")


def one_class(name: str, hit: str, false_hit: str, missed: str) -> str:
    return f"""select model, split, '{name}' as class,
      coalesce({hit} / nullif({hit} + {false_hit}, 0)::double, 0) as precision,
      coalesce({hit} / nullif({hit} + {missed}, 0)::double, 0) as recall,
      coalesce(2 * {hit} / nullif(2 * {hit} + {false_hit} + {missed}, 0)::double, 0) as f1,
      {hit} + {missed} as support from counts"""


ORACLES = {
    "confusion_matrix": f"with {JUDGED} select * from counts",
    "auc_rank_sum": f"with {JUDGED} select * from areas",
    "binary_metrics": f"with {JUDGED} select * from metrics",
    "metric_rows": f"""with {JUDGED} select model, split, metric, value from metrics
        unpivot (value for metric in (accuracy, f1, roc_auc))""",
    "class_report": f"""with {JUDGED}, classes as ({one_class('NORMAL', 'tn', 'fn', 'fp')}
          union all {one_class('URGENT', 'tp', 'fp', 'fn')}),
        n as (select * from classes where class = 'NORMAL'),
        u as (select * from classes where class = 'URGENT')
        select * from classes
        union all select model, split, 'macro avg', (n.precision + u.precision) / 2,
          (n.recall + u.recall) / 2, (n.f1 + u.f1) / 2, n.support + u.support
          from n join u using (model, split)
        union all select model, split, 'weighted avg',
          (n.precision * n.support + u.precision * u.support) / (n.support + u.support),
          (n.recall * n.support + u.recall * u.support) / (n.support + u.support),
          (n.f1 * n.support + u.f1 * u.support) / (n.support + u.support), n.support + u.support
          from n join u using (model, split)""",
    "model_selection": f"""with {JUDGED},
        wide as (select v.model, v.accuracy as val_accuracy, v.f1 as val_f1,
            v.roc_auc as val_roc_auc, t.accuracy as test_accuracy, t.f1 as test_f1,
            t.roc_auc as test_roc_auc
          from metrics v join metrics t on v.model = t.model
          where v.split = 'validation' and t.split = 'test')
        select *, test_accuracy - val_accuracy as accuracy_change, test_f1 - val_f1 as f1_change,
          test_roc_auc - val_roc_auc as roc_auc_change,
          model = first_value(model) over (order by val_f1 desc,
            list_position(['by_length', 'by_id', 'by_both'], model)) as is_best
        from wide""",
    "ticket_split": f"with {sql.FEATURED}, {TICKET_SPLIT} select * from parts",
    "document_split": f"""with {SPLIT.format(label='quality', key='doc_id', source='labels')}
        select * from parts""",
    "split_counts": f"""with {sql.FEATURED}, {TICKET_SPLIT}
        select split, is_urgent, count(*) as rows from parts group by split, is_urgent""",
    "unavailable_scores": f"""with {sql.CLEANED}
        select tweet_id, airline, text, 'UNAVAILABLE' as label, null::double as confidence,
          0.0::double as cost_usd from firsts""",
}
