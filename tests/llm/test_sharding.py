import random
import zlib
from collections import Counter, defaultdict

from helpers import frame
from hypothesis import given, settings
from hypothesis import strategies as st

from panelwright.llm.queries import op5_sharding
from panelwright.llm.sharding import schedule, shard


def loads_by_heap(sizes, n_shards):
    loads = [0] * n_shards
    for size, n in sizes:
        for _ in range(n):
            loads[loads.index(min(loads))] += size
    return loads


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 500), st.integers(1, 90), max_size=12), st.integers(1, 9))
def test_schedule_is_that_of_the_heap(sizes, n_shards):
    sizes = sorted(sizes.items(), reverse=True)
    plan = list(schedule(sizes, n_shards))
    assert all(cum[-1] == n for (_, n), (_, cum) in zip(sizes, plan, strict=True))
    loads = [sum(s * (cum[k] - (cum[k - 1] if k else 0)) for s, cum in plan) for k in range(n_shards)]
    assert loads == loads_by_heap(sizes, n_shards)


def test_plan_in_chunks(spark, monkeypatch):
    def loads():
        for k in range(3):
            slots = sorted(r.slot for r in got if r.shard == k)
            assert slots == list(range(len(slots)))
        return [sum(r.size for r in got if r.shard == k) for k in range(3)]

    docs = frame(spark, [(k, "x" * (k % 37), "s", "en") for k in range(200)] + [(500, "x" * 900, "s", "en")])
    got = shard(docs, 3).collect()
    whole = loads()
    monkeypatch.setattr("panelwright.llm.sharding.CHUNK", 5)
    monkeypatch.setattr("panelwright.llm.sharding.PART_ROWS", 10)
    got = shard(docs, 3).collect()
    assert loads() == whole


def test_shards(spark):
    rng = random.Random(4)
    texts = ["é" * rng.randrange(1, 60) + str(rng.randrange(6)) for _ in range(300)] + [None, None, "", "", "x" * 3000]
    rows = [(k, t, "s", "en") for k, t in enumerate(texts)] + [(5, texts[5], "s", "en"), (None, "no id", None, None)]
    got = shard(frame(spark, rows, "shard string, slot string, size string, grp string")).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    homes, slots, loads, groups = defaultdict(set), defaultdict(list), Counter(), Counter()
    by_id = {d: t for d, t, *_ in rows}
    for r in got:
        homes[by_id[r.doc_id]].add(r.shard)
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
        groups[by_id[r.doc_id]] += r.size
        assert r.law == "bytes" and r.grown_shard is None
    assert all(len(s) == 1 for s in homes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    ordered = sorted(Counter(groups.values()).items(), reverse=True)
    assert sorted(loads[k] for k in range(8)) == sorted(loads_by_heap(ordered, 8))
    assert shard(frame(spark, [])).collect() == []


def test_query_against_a_plain_heap(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op5_sharding(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    groups, homes, loads = Counter(), defaultdict(set), Counter()
    for r in got:
        assert r.size == len((texts[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode())
        groups[texts[r.doc_id]] += r.size
        homes[texts[r.doc_id]].add(r.shard)
        loads[r.shard] += r.size
    assert all(len(s) == 1 for s in homes.values())
    assert sorted(loads[k] for k in range(8)) == sorted(loads_by_heap(sorted(Counter(groups.values()).items(), reverse=True), 8))
    assert all(sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got))) for k in range(8))
