import math
from collections import Counter

import plain
import xxhash

from ticketloom.llm import catalog, rendezvous


def draw(key, shard):
    seed = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)
    bits = xxhash.xxh64_intdigest(shard.to_bytes(4, "little", signed=True), seed) >> 11
    return (bits + 0.5) / 2**53


def test_given_table(spark):
    got = catalog.op7_rendezvous_shards(spark, plain.SF01).collect()
    docs = {d["doc_id"]: d for d in plain.rows("documents", plain.SF01)}
    assert len(got) == len(docs)
    for r in got:
        data = (docs[r["doc_id"]]["text"] or "").encode()
        assert r["size"] == len(data) + 16 and r["text_crc32"] == plain.crc(data)
        draws = [draw(r["doc_id"], i) for i in range(41)]
        assert r["shard"] == max(range(40), key=lambda i: draws[i])
        assert r["grown_shard"] == max(range(41), key=lambda i: draws[i])
        assert r["grown_shard"] in (r["shard"], 40) and r["law"] == "key"
    for shard, n in Counter(r["shard"] for r in got).items():
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(n))


def test_weights_decide_shares(spark):
    weights = [1.0, 2.0, 5.0]
    got = rendezvous.with_shards(spark.range(4000), "id", weights).collect()
    share = Counter(r["shard"] for r in got)
    for i, w in enumerate(weights):
        assert abs(share[i] / 4000 - w / 8) < 0.03
    for r in got[:200]:
        assert r["shard"] == min(range(3), key=lambda i: -math.log(draw(r["id"], i)) / weights[i])


def test_repeated_rows_nulls_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(rendezvous, "RANGE_ROWS", 50)
    rows = [(None, 1)] * 400 + [(i, i % 3) for i in range(500)] + [(7, 1)] * 120
    df = spark.createDataFrame(rows, "doc_id long, slot int")
    out = rendezvous.with_slots(rendezvous.with_shards(df.withColumnRenamed("slot", "n"), "doc_id",
                                                       [1.0] * 4), "shard", ["doc_id"]).collect()
    assert Counter((r["doc_id"], r["n"]) for r in out) == Counter(rows)
    for shard in range(4):
        slots = sorted(r["slot"] for r in out if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert len({r["shard"] for r in out if r["doc_id"] is None}) == 1
    empty = rendezvous.with_slots(rendezvous.with_shards(df.limit(0).drop("slot"), "doc_id", [1.0]),
                                  "shard", ["doc_id"])
    assert empty.collect() == []
