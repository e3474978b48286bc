import numpy as np
import plain
import sentencepiece
from pyspark.sql import functions as F
from test_near_dup import classes

import corpus_pipeline
from ticketloom.llm import catalog, pieces, pii


def test_stages_take_effect(spark):
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5
    docs = {d["doc_id"]: d for d in plain.rows("documents")}
    good = {r["doc_id"] for r in catalog.op5_subword_quality(spark, plain.SF).collect() if r["predicted"]}
    kept = sorted(good)
    group = classes([docs[i]["text"] for i in kept])
    first = [i for n, i in enumerate(kept) if group[n] == n]
    dirty = {r[0] for r in plain.contamination([docs[i] for i in first], plain.rows("benchmark")) if r[-1]}
    want = {i: pii.redact(docs[i]["text"], pii.find(docs[i]["text"])) for i in first if i not in dirty}
    assert len(docs) > len(good) > len(first) > len(want) > 0

    got = corpus_pipeline.run(spark, plain.SF).collect()
    assert {r["doc_id"] for r in got} == set(want) and len(got) == len(want)
    vocabulary = pieces.Vocabulary(catalog.tokenizer_path("piece_bpe_32k.model"))
    for r in got:
        assert vocabulary.decode(r["piece_ids"]) == want[r["doc_id"]]
        assert r["round_trip"] and r["n_chars"] == len(want[r["doc_id"]])
        assert plain.crc(np.array(r["piece_ids"], "<u4").tobytes()) == r["piece_crc32"]


def test_all_but_the_last_stage_return_documents(spark):
    docs = spark.read.parquet(f"{plain.SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, plain.SF).columns == docs.columns


def test_columns_of_any_name_come_through(spark):
    names = ["pii", "class_id", "class_size", "is_first", "contaminated", "_score", "n_words", "hit_spans", "_whole",
             "_text", "_row", "c0", "rest", "n_pieces"]
    docs = spark.read.parquet(f"{plain.SF}/documents.parquet").select("doc_id", "text", *[
        F.concat(F.lit(f"{n} "), F.col("doc_id")).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, plain.SF)
        assert found.columns == docs.columns
        rows = found.collect()
        assert rows and all(r[n] == f"{n} {r['doc_id']}" for r in rows for n in names), name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, plain.SF).collect()
    assert len(last) == docs.count() and all(r["_whole"] == f"_whole {r['doc_id']}" for r in last)


def test_nulls_repeats_and_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{plain.SF}/documents.parquet")
    extra = docs.filter("doc_id < 3").unionByName(docs.filter("doc_id < 3")).unionByName(
        docs.limit(2).selectExpr("cast(null as long) doc_id", "text", "lang", "source", "n_chars")).unionByName(
        docs.limit(2).selectExpr("doc_id + 100000 doc_id", "cast(null as string) text", "lang", "source", "n_chars"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{plain.SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs.unionByName(extra).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = [tuple(r["piece_ids"]) for r in got if r["piece_ids"]]  # null texts are no copies of each other
    assert texts and len(texts) == len(set(texts)) and all(r["round_trip"] for r in got)
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_ids_decode_in_the_library_too(spark):
    held = sentencepiece.SentencePieceProcessor(model_file=catalog.tokenizer_path("piece_bpe_32k.model"))
    vocabulary = pieces.Vocabulary(catalog.tokenizer_path("piece_bpe_32k.model"))
    texts = [d["text"] for d in plain.rows("documents")[:50]]
    for text, found in zip(texts, pieces.Encoder(vocabulary, 1)(texts)):
        ids = np.frombuffer(found[0][1], "<u4").tolist()
        assert held.decode(ids) == text
