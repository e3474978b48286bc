"""Range-read CSV, state that does not forget, versioned models, completions, sketches, evidence."""

import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from ticketloom import fixed_values as fv
from ticketloom.catalog.messages import features_of_tickets
from ticketloom.functions.rules import TRIAGE_RULES
from ticketloom.operators import audit_sketches as sk
from ticketloom.operators import evidence as ev
from ticketloom.plans import completions
from ticketloom.plans.training import assembler
from ticketloom.session import scratch_path
from ticketloom.sources import csv_ranges, models
from ticketloom.sources.tables import CSV
from ticketloom.streaming import first_ever as fe
from ticketloom.streaming import jobs


# --- CSV by ranges ---------------------------------------------------------------------------

FILES = {
    "a.csv": 'a,b,c\n1,"x\ny ""q"" z",3\n\n2,,""\n4,"multi\n\n\nline, long ' + "w " * 50
             + '",5\n7,8\n9,10,11,12\n" s ", t ,"é\r\nü"\n',
    "b.csv": 'a,b,c\r\n1,"xy",3\r\n2,4,5',
    "c.csv": "a,b,c\n",
    "d.csv": 'a,b,c\n"' + 'long ""text""\n' * 200 + '",2,3\n',
}


@pytest.fixture
def csv_folder(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).write_text(text, newline="")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield str(tmp_path)
    for k, v in kept.items():
        spark.conf.set(k, v)


def cells(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("size", [100_000, 300, 64, 17, 3])
def test_ranges_give_what_one_task_reads(spark, csv_folder, size):
    want = cells(spark.read.options(**CSV).csv(csv_folder))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    found = csv_ranges.read_csv(spark, csv_folder)
    assert cells(found.rows) == want and len(want) == 9
    assert sorted(r["text"] for r in found.malformed.collect()) == ["7,8", "9,10,11,12"]
    lines = csv_ranges._lines(spark, csv_folder)
    if size < 100:
        assert lines.rdd.getNumPartitions() > 20
        assert csv_ranges.start_states(lines).filter("inside").count() > 5


def test_random_tables_at_random_ranges(spark, tmp_path):
    rng = random.Random(7)
    parts = ["x", '""', "\n", ",", " ", "é", "\r", "0"]
    for trial in range(4):
        folder = tmp_path / str(trial)
        folder.mkdir()
        rows = [["".join(rng.choices(parts, k=rng.randrange(9))) for _ in range(3)] for _ in range(60)]
        text = "a,b,c\n" + "".join(",".join(f'"{c}"' for c in r) + "\n" for r in rows)
        (folder / "t.csv").write_text(text, newline="")
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(rng.randrange(5, 90)))
        try:
            got = cells(csv_ranges.read_csv(spark, str(folder)).rows.fillna(""))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert got == sorted((tuple(c.replace('""', '"') for c in r) for r in rows), key=repr)


def test_a_quote_that_never_closes_lands_in_the_side_table(spark, csv_folder):
    with open(f"{csv_folder}/e.csv", "w") as out:
        out.write('a,b,c\n1,2,3\n4,"5,6\n' + "7,8,9\n" * 300)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    found = csv_ranges.read_csv(spark, f"{csv_folder}/e.csv", most_chars=1000)
    assert cells(found.rows) == [("1", "2", "3")]
    assert sum(r["text"].count("7,8,9") for r in found.malformed.collect()) == 300


# --- first ever ------------------------------------------------------------------------------

def test_first_ever_drops_late_copies_and_survives_a_restart(spark, tmp_path):
    rows = [(i, f"k{i % 7}" if i % 3 else "hot", i) for i in range(300)]
    df = spark.createDataFrame(rows + [(None, "k1", 1), (900, None, 1)], "id long, text string, n long").selectExpr(
        "id", "text", "timestamp_seconds(n * 86400) as at")
    session, source = fe.with_rocksdb(spark), str(tmp_path / "in")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for part in range(3):  # each run finds one more file: a restart from the checkpoint in between
        df.filter((F.col("id") / 100).cast("int") == part).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.message_stream(session, source, df.schema)
        jobs.finish(jobs.start_files(fe.first_ever(stream, "text", "id", "at", delay_days=30), out, checkpoint))
    found = [r for r in spark.read.parquet(out).collect()]
    firsts = {r["key"]: r["row_id"] for r in found if r["row_id"] is not None}
    want = {}
    for i, key, _ in rows:
        want.setdefault(key, i)
    assert firsts == want and len([r for r in found if r["row_id"] is not None]) == len(want)
    assert sum(r["copies"] for r in found) == 300 - len(want)
    late = sum(r["late"] for r in found)
    assert 0 < late < 300 - len(want)  # a watermark of 30 days would have let these pass
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != fe.PROVIDER


def test_first_ever_keeps_long_ids_and_calls_python_by_bucket(spark, tmp_path):
    big = 2 ** 53 + 1
    df = spark.range(2_000).selectExpr(f"id + {big} as id", "concat('k', id % 600) as text",
                                       "timestamp_seconds(id) as at")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.message_stream(fe.with_rocksdb(spark), str(tmp_path / "in"), df.schema)
    firsts = fe.first_ever(stream, "text", "id", "at")
    plan = firsts._jdf.queryExecution().analyzed().toString()
    assert "transformwithstate" in plan.lower() and "bucket" in plan
    path = str(tmp_path / "out")
    jobs.finish(jobs.start_files(firsts, path, path + "-checkpoint"))
    found = spark.read.schema(firsts.schema).parquet(path).collect()
    assert {r["key"]: r["row_id"] for r in found if r["row_id"] is not None} == {
        f"k{i}": big + i for i in range(600)}
    assert sum(r["copies"] for r in found) == 1_400


# --- versioned models ------------------------------------------------------------------------

def test_each_batch_keeps_its_model_version(spark, sf, tmp_path, monkeypatch):
    rows = features_of_tickets(spark, sf).select("is_urgent", *fv.FEATURES)
    pipeline = [Pipeline(stages=[assembler(), LogisticRegression(
        featuresCol="features_vector", labelCol="is_urgent", maxIter=n)]) for n in (1, 20)]
    store, source, out = (str(tmp_path / n) for n in ("models", "in", "out"))
    df = spark.createDataFrame([(i, "u", True, "@Delta my bag is lost, help please", None) for i in range(3)],
                               "tweet_id long, author_id string, inbound boolean, text string, created_at string")

    def arrive(first):
        df.withColumn("tweet_id", F.col("tweet_id") + first).coalesce(1).write.mode("append").parquet(source)

    def run():
        jobs.finish(jobs.start_scored(jobs.message_stream(spark, source, df.schema), store, out, out + "-c"))
        return {r["tweet_id"]: (r["model_version"], r["label"]) for r in spark.read.parquet(out).collect()}

    arrive(0)
    assert set(run().values()) == {(0, "UNAVAILABLE")}
    assert models.publish(pipeline[0].fit(rows), fv.FEATURES, store, spark) == 1
    arrive(10)
    real = jobs.score_texts

    def crash(*args, **kw):
        raise OSError("lost")

    monkeypatch.setattr(jobs, "score_texts", crash)
    with pytest.raises(Exception):
        run()
    monkeypatch.setattr(jobs, "score_texts", real)
    assert models.publish(pipeline[1].fit(rows), fv.FEATURES, store, spark) == 2
    got = run()  # the repeated batch keeps the version it began with
    assert {v for i, (v, _) in got.items() if i >= 10} == {1} and len(got) == 6
    arrive(20)
    assert {i: v for i, (v, _) in run().items()} == {0: 0, 1: 0, 2: 0, 10: 1, 11: 1, 12: 1, 20: 2, 21: 2, 22: 2}


# --- completions -----------------------------------------------------------------------------

def test_a_killed_run_asks_no_committed_prompt_twice(spark, tmp_path, monkeypatch):
    path, log = str(tmp_path / "store"), str(tmp_path / "asked")
    prompts = spark.createDataFrame([(i, f"prompt {i % 60}") for i in range(200)] + [(999, None)],
                                    "id long, prompt string")

    def service(batch: pd.Series) -> pd.DataFrame:
        import os
        import uuid
        os.makedirs(log, exist_ok=True)
        batch.to_csv(f"{log}/{uuid.uuid4().hex}", index=False, header=False)
        bad = batch.str.endswith("7")
        return pd.DataFrame({"completion": batch.where(~bad, "[LLM unavailable: busy]"),
                             "input_tokens": 1, "output_tokens": 2, "provider": "primary"})

    real, waves = completions._commit, []

    def killed(*args):
        waves.append(1)
        if len(waves) == 4:
            raise KeyboardInterrupt
        real(*args)

    monkeypatch.setattr(completions, "_commit", killed)
    with pytest.raises(KeyboardInterrupt):
        completions.complete_all(prompts, service, path, waves=8, tries=2)
    stored = {r["prompt_hash"] for r in completions.answers(spark, path).collect()}
    assert stored
    monkeypatch.setattr(completions, "_commit", real)
    import glob
    before = {name: open(name).read().split("\n") for name in glob.glob(log + "/*")}
    completions.complete_all(prompts, service, path, waves=8, tries=2)
    completions.complete_all(prompts, service, path, waves=8, tries=2)
    later = [line for name in glob.glob(log + "/*") if name not in before for line in open(name).read().split()]
    hashes = {r["p"]: r["h"] for r in prompts.dropna().selectExpr("prompt p", "sha2(prompt, 256) h").collect()}
    asked_later = [f"prompt {n}" for n in later if n != "prompt"]
    assert not {hashes[p] for p in asked_later} & stored
    assert all(asked_later.count(f"prompt {n}") <= 1 for n in range(60) if n % 10 != 7)
    found = completions.with_answers(prompts, path).collect()
    assert len(found) == 201
    for r in found:
        assert r["completion"] == (None if r["prompt"] is None or r["prompt"].endswith("7") else r["prompt"])
    failed = completions.failures(spark, path, 2).collect()
    assert len(failed) == 6 and {r["calls"] for r in failed} == {2}


# --- daily sketches --------------------------------------------------------------------------

def test_a_new_day_reads_only_itself_and_ranks_stay_within_the_error(spark, tmp_path):
    path, rng = str(tmp_path / "days"), np.random.default_rng(3)
    values = {d: rng.lognormal(size=20_000) * (1 + d) for d in range(4)}

    def day(d):
        rows = spark.createDataFrame(pd.DataFrame({"v": values[d]}))
        return rows.select(
            F.lit(f"2024-01-0{d + 1}").alias("day"), F.lit(True).alias("low_similarity"),
            F.lit("URGENT").alias("ml_label"), F.lit("NORMAL").alias("llm_label"),
            *[F.lit(0.5).alias(c) for c in sk.COSTS], *[F.col("v").alias(c) for c in sk.LATENCIES])

    sk.write_days(day(0).unionByName(day(1)).unionByName(day(2)), path)
    import os
    old = {f"{p}/{n}": os.path.getmtime(f"{p}/{n}") for p, _, names in os.walk(path) for n in names if "part" in n}
    sk.write_days(day(3), path)
    assert all(os.path.getmtime(name) == at for name, at in old.items())
    every = np.sort(np.concatenate(list(values.values())))
    probabilities = (0.01, 0.5, 0.95, 0.99)
    for r in sk.quantiles(spark, path, probabilities).collect():
        rank = np.searchsorted(every, r["value"]) / len(every)
        assert r["n"] == 80_000 and abs(rank - r["p"]) <= sk.RANK_ERROR
    total = sk.roll_up(spark, path).first()
    assert (total["calls"], total["compared"], total["agreed"], total["low_similarity_pct"]) == (80_000, 80_000, 0, 100)
    sk.write_days(day(3), path)  # a repeated day replaces itself
    assert sk.roll_up(spark, path).first()["calls"] == 80_000


# --- evidence --------------------------------------------------------------------------------

def brute(texts, phrases):
    inside = re.compile(r"[^\W]")
    out = set()
    for key, text in texts:
        low = ev.folded(text)
        for rule, phrase in phrases:
            if ev.PLAIN.fullmatch(phrase):
                spots = [i for i in range(len(low)) if low.startswith(ev.folded(phrase), i)]
                out |= {(key, rule, phrase, i, i + len(phrase)) for i in spots
                        if not (i and inside.match(text[i - 1]))
                        and not (i + len(phrase) < len(text) and inside.match(text[i + len(phrase)]))}
            else:
                out |= {(key, rule, phrase, m.start(), m.end())
                        for m in re.finditer(rf"(?<!\w)(?:{phrase})(?!\w)", text, re.I)}
    return out


def test_evidence_equals_a_scan_of_every_phrase(spark):
    rng = random.Random(5)
    vocabulary = ["late", "on hold", "hold", "REFUND", "delayed", "2 hours", "é", "waiting", "still waiting",
                  "İstanbul", "lost_bag", "x", "", "help!", "cancelled", "3hrs"]
    texts = [(i, rng.choice([" ", ", ", "\n", ""]).join(rng.choices(vocabulary, k=8))) for i in range(300)]
    phrases = ev.phrases_of(TRIAGE_RULES) + [("own", "help!"), ("own", "é"), ("again", "late"), ("own", "")]
    df = spark.createDataFrame([*texts, (999, None)], "id long, text string")
    got = [tuple(r) for r in ev.evidence(df, "id", "text", phrases).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(texts, [p for p in phrases if p[1]])


def test_ten_thousand_phrases(spark):
    phrases = [("big", f"phrase {i}") for i in range(10_000)]
    df = spark.range(2000).selectExpr("id", "concat('a phrase ', id * 5, ' and phrase ', id, '.') as text")
    got = ev.evidence(df, "id", "text", phrases)
    assert got.count() == 4000
    with pytest.raises(ValueError):
        ev.evidence(df, "id", "text", (("r", str(i)) for i in range(ev.MOST_PHRASES + 1)))
    assert ev.evidence(df, "id", "text", []).count() == 0
