"""Metrics against direct computation and the training job end to end."""

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Observation
from pyspark.sql import functions as F

from ticketloom import fixed_values as fv
from ticketloom.catalog.messages import features_of_tickets, short_tickets
from ticketloom.operators import evaluation as ev
from ticketloom.plans import training as tr
from ticketloom.sources.models import load_model


def predictions(spark, n=400, ties=True):
    rng = np.random.default_rng(1)
    score = rng.integers(0, 20, n) / 20 if ties else rng.random(n)
    label = (rng.random(n) < 0.3 + 0.4 * score).astype(int)
    rows = [("m", "test", int(a), int(s >= 0.5), float(s)) for a, s in zip(label, score)]
    return rows, spark.createDataFrame(rows, "model string, split string, label int, "
                                             "prediction int, score double")


@pytest.mark.parametrize("ties", [True, False])
def test_auc_equals_pairwise_wins_and_the_evaluator(spark, ties):
    rows, df = predictions(spark, ties=ties)
    pos = np.array([r[4] for r in rows if r[2]])[:, None]
    neg = np.array([r[4] for r in rows if not r[2]])[None, :]
    wins = ((pos > neg) + 0.5 * (pos == neg)).mean()
    assert ev.auc(df).first()["roc_auc"] == pytest.approx(wins, abs=1e-12)
    judge = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label")
    assert judge.evaluate(df) == pytest.approx(wins, abs=1e-6)


def test_report_and_metrics(spark):
    rows, df = predictions(spark)
    y, p = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    tp, fp, fn, tn = ((y & p).sum(), ((1 - y) & p).sum(), (y & (1 - p)).sum(),
                      ((1 - y) & (1 - p)).sum())
    m = ev.binary_metrics(df).first()
    assert m["accuracy"] == (tp + tn) / len(y) and m["f1"] == 2 * tp / (2 * tp + fp + fn)
    report = {r["class"]: r for r in ev.classification_report(df).collect()}
    assert report["URGENT"]["precision"] == tp / (tp + fp)
    assert report["NORMAL"]["recall"] == tn / (tn + fp)
    assert report["macro avg"]["support"] == len(y)
    assert report["weighted avg"]["recall"] == pytest.approx(m["accuracy"])


def test_one_class_only(spark):
    df = spark.createDataFrame([("m", "test", 0, 0, 0.1), ("m", "test", 0, 0, 0.2)],
                               "model string, split string, label int, prediction int, score double")
    m = ev.binary_metrics(df).first()
    assert (m["accuracy"], m["f1"], m["roc_auc"]) == (1.0, 0.0, None)


def test_selection_takes_the_first_of_equals(spark):
    rows = [(m, s, 0.9, f, 0.5) for m, f in (("a", 0.5), ("b", 0.7), ("c", 0.7))
            for s in ("validation", "test")]
    metrics = spark.createDataFrame(rows, "model string, split string, accuracy double, f1 double, "
                                          "roc_auc double")
    best = {r["model"]: r["is_best"] for r in ev.compare_models(metrics, ["a", "b", "c"]).collect()}
    assert best == {"a": False, "b": True, "c": False}
    turned = ev.compare_models(metrics, ["c", "b", "a"]).filter("is_best").first()
    assert turned["model"] == "c" and turned["f1_change"] == 0


def test_candidates_keep_the_declared_protocol():
    tried = tr.candidates(200)
    assert list(tried) == ["logistic_regression", "random_forest", "gradient_boosting"]
    lr, rf, gb = tried.values()
    assert lr.getMaxIter() == 1000 and lr.getRegParam() == 1 / 200 and not lr.getStandardization()
    assert rf.getNumTrees() == 100 and rf.getFeatureSubsetStrategy() == "sqrt"
    assert gb.getMaxIter() == 100 and gb.getMaxDepth() == 3 and gb.getStepSize() == 0.1


def test_models_score_in_a_session_that_observes_metrics(spark, sf):
    rows = features_of_tickets(spark, sf)
    seen = Observation("rows")
    assert rows.observe(seen, F.count("*").alias("n")).count() == seen.get["n"]
    done = tr.train(rows, trees=2, depth=3, iterations=5)
    assert done.predictions.select("model").distinct().count() == 3
    assert not any(m.stages[-1].hasSummary for m in (
        done.models["logistic_regression"], done.models["random_forest"]))


def test_training_job(spark, sf, tmp_path):
    features = features_of_tickets(spark, sf)
    done = tr.train_and_save(features, str(tmp_path), trees=5, depth=4, iterations=20)
    rows = {r["model"]: r for r in done.comparison.collect()}
    assert set(rows) == {"logistic_regression", "random_forest", "gradient_boosting"}
    assert rows[done.best]["is_best"] and rows[done.best]["val_f1"] == max(
        r["val_f1"] for r in rows.values())
    assert rows[done.best]["test_roc_auc"] > 0.8  # the label is a rule over the same text
    document = spark.read.json(f"{tmp_path}/metrics").first()
    assert document["dataset_size"] == 368 == sum(
        document[k] for k in ("train_size", "val_size", "test_size"))
    assert document["best_model"] == done.best and document["features"] == list(fv.FEATURES)
    assert set(document["models"].asDict()) == set(rows)
    model, names = load_model(spark, str(tmp_path))
    assert names == fv.FEATURES
    assert load_model(spark, str(tmp_path / "none")) == (None, ())
    scored = tr.score_texts(model, short_tickets(spark, sf), "text", names)
    assert scored.columns == ["tweet_id", "airline", "text", "label", "confidence", "cost_usd"]
    labels = {r["label"]: r["count"] for r in scored.groupBy("label").count().collect()}
    assert set(labels) == {"URGENT", "NORMAL"} and sum(labels.values()) == 368
    low, high = scored.agg(F.min("confidence"), F.max("confidence")).first()
    assert 0.5 <= low <= high <= 1.0


def test_missing_feature_columns_raise(spark):
    with pytest.raises(ValueError, match="missing columns"):
        tr.train(spark.range(3))
