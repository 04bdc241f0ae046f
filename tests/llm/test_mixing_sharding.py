import re
import zlib
from collections import defaultdict

import pytest

from llm_cases import SF, edge_docs, edge_rows, empty_docs

from pagefold.llm import mixing, sharding


def filled(sizes):
    """Targets by sharing again and again until none is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total >= 2 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        share = left
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.discard(s)
        assert share >= left
    return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("make", ["edge", "table"])
def test_mix(spark, make):
    docs = edge_docs(spark) if make == "edge" else spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    raw = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    got = mixing.mix(docs).collect()
    assert sorted((repr(r.doc_id), r.size) for r in got) == sorted((repr(i), words(t)) for i, t, _ in raw)
    sizes = defaultdict(int)
    for _, t, s in raw:
        sizes[s] += words(t)
    exp, taken, largest = filled(sizes), defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - exp[r.source]) < 1e-6 * max(1, exp[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - exp[s]) <= largest[s]
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (repr(r.doc_id), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_many_levels(spark):
    docs = spark.range(9000).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id % 9 AS int)) AS text", "if(id % 3 = 0, 'hot', concat('s', id % 5)) AS source")
    got = mixing.mix(docs).groupBy("source").agg({"taken": "sum", "target": "max", "size": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= r["max(size)"] for r in got)


def test_resample_and_empty(spark):
    docs = edge_docs(spark)
    out = mixing.resample(docs)
    assert out.columns == docs.columns
    plan = {r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.doc_id not in (None, 9)}
    count = defaultdict(int)
    for r in out.collect():
        count[r.doc_id] += 1
    assert all(count[i] == n for i, n in plan.items())
    assert mixing.mix(empty_docs(spark)).collect() == [] and mixing.resample(empty_docs(spark)).collect() == []


def test_shards(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    got = sharding.kd_shards(docs, shards=16).collect()
    assert {r.doc_id for r in got} == set(text) and len(got) == len(text)
    slots, size, home = defaultdict(list), defaultdict(int), {}
    for r in got:
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
        assert home.setdefault(raw, r.shard) == r.shard
    assert sorted(slots) == list(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(size.values()) / 16
    assert all(abs(s - mean) < 0.1 * mean for s in size.values())


def test_shards_edge_rows(spark):
    got = sharding.kd_shards(edge_docs(spark), shards=16).collect()
    assert len(got) == len(edge_rows()) and all(0 <= r.shard < 16 for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.kd_shards(empty_docs(spark), shards=16).collect() == []
    assert {r.shard for r in sharding.kd_shards(edge_docs(spark), target_bytes=1 << 30).collect()} == {0}
    assert {r.shard for r in sharding.kd_shards(edge_docs(spark), shards=3).collect()} <= {0, 1, 2}


def test_native(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (mixing.mix(docs), sharding.kd_shards(docs, shards=4)):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Arrow|Pandas", plan)
