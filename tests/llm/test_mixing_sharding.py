from __future__ import annotations

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from graphspark.llm import mixing, sharding


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        left = share * sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        target = {s: most * sizes[s] if s in capped else left * w[s] / sum(w[x] for x in free) for s in order}
        over = [s for s in free if target[s] > most * sizes[s]]
        if not over:
            return target
        capped |= set(over)


def test_targets():
    sizes = {"b": 100, "a": 10, None: 50, "c": 1000, "d": 0}
    got = mixing.targets(list(sizes.items()), (5, 2, 1), 1.5, 2.0)
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 for s in want)
    assert mixing.targets([], (1,), 1.5, 2.0) == {}


@pytest.mark.parametrize("range_rows", [2000, 7])
def test_plan(spark, monkeypatch, range_rows):
    monkeypatch.setattr(mixing, "RANGE_ROWS", range_rows)
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    got = mixing.plan(docs).collect()
    again = {r.doc_id: r.taken for r in mixing.plan(docs.repartition(5)).collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for i, r in rows.items()}
    per = {}
    for i, r in rows.items():
        per[r.source] = per.get(r.source, 0) + size[i]
    want, taken, biggest = brute_targets(per), dict.fromkeys(per, 0), dict.fromkeys(per, 0)
    for r in got:
        s = rows[r.doc_id].source
        assert r["size"] == size[r.doc_id] and r.source_size == per[s] and abs(r.target - want[s]) < 1e-6
        assert r.taken <= 2 * r["size"] and r.taken == again[r.doc_id] == r.copies * r["size"]
        assert len(r.positions) == r.copies and all(0 <= p <= 1 for p in r.positions)
        taken[s] += r.taken
        biggest[s] = max(biggest[s], r["size"])
    assert all(abs(taken[s] - want[s]) <= biggest[s] for s in per)


@pytest.mark.parametrize("few", [False, True])
def test_plan_by_hand(spark, monkeypatch, few):
    """Starts, copies and positions from the definition: one running sum for each source over all rows by hash."""
    if few:  # several blocks of ranges, and sources shared out by jobs
        for name, value in (("RANGE_ROWS", 3), ("BLOCK_RANGES", 4), ("DRIVER_SOURCES", 1)):
            monkeypatch.setattr(mixing, name, value)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.unionByName(docs.limit(20)).unionByName(docs.where("doc_id % 9 = 0").withColumn("source", F.lit(None).cast("string")).withColumn("doc_id", F.lit(None).cast("long")))
    rows = docs.select("doc_id", "text", "source", F.xxhash64("doc_id", "text", F.lit("mix")).alias("h")).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    per = {}
    for r in rows:
        per.setdefault(r.source, []).append((r.h, str(r.doc_id) if r.doc_id is not None else "", size(r.text)))
    totals = {s: sum(n for _, _, n in x) for s, x in per.items()}
    goal, want = brute_targets(totals), []
    for k, s in enumerate(sorted(per, key=lambda s: (s is None, s or ""))):
        start, whole = 0, int(goal[s] / totals[s] + 1e-12)
        slope = (0.5, 1.0, 1.5)[k % 3]
        for _, i, n in sorted(per[s]):
            copies = whole + (n > 0 and start + n / 2 <= goal[s] - whole * totals[s])
            at = []
            for c in range(copies):
                due, lo, hi = min(1.0, (c * totals[s] + start) / goal[s]), 0.0, 1.0
                for _ in range(60):  # the demand grows with time: halve
                    mid = (lo + hi) / 2
                    lo, hi = (mid, hi) if slope * mid + (1 - slope) * mid * mid < due else (lo, mid)
                at.append(round(lo, 6))
            want.append((str(s), i, n, start, copies, at))
            start += n
    got = [(str(r.source), "" if r.doc_id is None else str(r.doc_id), r["size"], r.start, r.copies, [round(p, 6) for p in r.positions]) for r in mixing.plan(docs).collect()]
    assert [x[:5] for x in sorted(got)] == [x[:5] for x in sorted(want)]
    assert all(abs(a - b) < 2e-6 for x, y in zip(sorted(got), sorted(want)) for a, b in zip(x[5], y[5]))


def test_curriculum_moves_weight(spark):
    rows = [(i, "w " * 10, "early" if i % 2 else "late") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.plan(docs, weights=(1,), share=1.0, slopes=(1.5, 0.5)).collect()  # early: from 1.5 to 0.5 of its mean
    half = {s: [p < 0.5 for r in got if r.source == s for p in r.positions] for s in ("early", "late")}
    assert abs(sum(half["early"]) / len(half["early"]) - 0.625) < 0.03
    assert abs(sum(half["late"]) / len(half["late"]) - 0.375) < 0.03


def test_mix_has_the_planned_copies_in_order(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = {r.doc_id: r for r in mixing.plan(docs).collect()}
    got = mixing.mix(docs).collect()
    assert got[0].asDict().keys() == set(docs.columns)
    n = {}
    for r in got:
        n[r.doc_id] = n.get(r.doc_id, 0) + 1
    assert n == {i: r.copies for i, r in plan.items() if r.copies}
    seen, at = {}, []
    for r in got:
        k = seen[r.doc_id] = seen.get(r.doc_id, -1) + 1
        at.append(plan[r.doc_id].positions[k])
    assert at == sorted(at)


def test_odd_rows(spark, odd_docs, no_docs):
    got = mixing.plan(odd_docs).collect()
    assert len(got) == 10 and all(r.taken <= 2 * r["size"] for r in got)
    assert sum(r["size"] for r in got if r.source == "a") == sum(r.source_size for r in got if r.doc_id == 8)
    assert mixing.plan(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0
    assert mixing.mix(odd_docs).columns == odd_docs.columns


def test_lookup_table_is_even_and_steady():
    names = sharding.shard_names(64)
    table = sharding.lookup_table(names, 10_007)
    per = [table.count(i) for i in range(64)]
    assert min(per) > 0 and max(per) - min(per) <= 1
    fewer = sharding.lookup_table(names[:-1], 10_007)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 63)
    assert moved < 0.1 * len(table)
    assert [names[i] for i in table] == [list(reversed(names))[i] for i in sharding.lookup_table(list(reversed(names)), 10_007)]
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 10_000)


def test_placing(spark, odd_docs, no_docs):
    got = sharding.place(odd_docs, ["x", "y", "z"], 101).collect()
    assert len(got) == 10 and {r.slot for r in got if r.doc_id is None} == {0}
    assert len({r.shard for r in got if r.doc_id == 6}) == 1 and {r["a.b"] for r in got} == {8}
    assert sharding.place(no_docs, ["x"], 101).count() == 0


def test_sql(spark):
    from graphspark.llm import queries

    folder = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = sorted(duckdb.sql(queries.oracle_sql()["op10_shards"]).fetchall())
    assert sorted(tuple(r) for r in queries.op10_shards(spark, folder).collect()) == want
