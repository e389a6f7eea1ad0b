from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from graphspark.llm import jaccard


def corpus(seed, groups=80):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    shared = [r.choice(words) for _ in range(30)]
    rows = []
    for _ in range(groups):
        base = [r.choice(words) for _ in range(r.choice([1, 2, 3, 5, 8, 14, 40, 90, 200]))] + (shared if r.random() < 0.3 else [])
        for _ in range(r.choice([1, 1, 3, 9])):
            copy = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 5])):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((len(rows) * 7 % 1009 + len(rows) * 1009, " ".join(copy)))
    return rows


def test_similar_sets_share_a_signature():
    bands, r = jaccard.Bands(85), np.random.default_rng(0)
    for _ in range(400):
        n = int(r.integers(2, 400))
        x = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        drop = int(r.integers(0, max(1, int(0.16 * n)) + 1))
        y = np.unique(np.concatenate([x[drop:], r.integers(0, 2**63, int(r.integers(0, drop + 1)), dtype=np.uint64)]))
        if jaccard.similar(x, y, 85) and not np.array_equal(x, y):
            assert len(np.intersect1d(bands.signatures(x), bands.signatures(y)))
            assert jaccard._close(bands, [bands.sketch(x).tobytes()], [bands.sketch(y).tobytes()], np.array([len(x)]), np.array([len(y)]))[0]


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_against_all_pairs(spark, seed):
    rows = [*corpus(seed), (10**9, None), (10**9 + 1, ""), (None, "a b c")]
    got = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    want = jaccard.brute_classes(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_other_thresholds(spark):
    rows = corpus(3, 40)
    got = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string"), n=5, percent=80).collect()
    assert {r.doc_id: r.component_id for r in got} == jaccard.brute_classes(rows, 5, 80)


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    rows = corpus(4, 40)
    got = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == jaccard.brute_classes(rows)


def close_texts(count=200):
    """Texts of 100 words, 91 of them common to all: most pairs pass the sketches and none links, but for the first 40
    and every third later one, which hold three or more words of the one before."""
    common, rows = [f"c{k}" for k in range(91)], []
    for i in range(count):
        own = [f"w{i}-{k}" for k in range(9)]
        if 0 < i < 40 or i % 3 == 0:
            own[:3] = [f"w{i - 1}-{k}" for k in range(5, 8)]
        rows.append((i * 7 + 1, " ".join(common + own)))
    return rows


def test_dense_blocks_make_no_more_rows_than_members():
    bands, rows = jaccard.Bands(85), close_texts()
    sets = [jaccard.shingles(t, 1) for _, t in rows]
    n, ids = len(rows), [i for i, _ in rows]
    batch = pa.RecordBatch.from_pydict({"task": [1] * n, "doc_id": ids, "comp": ids, "size": [len(x) for x in sets], "sketch": [bands.sketch(x).tobytes() for x in sets], "block": [0] * n})
    assert 1 <= sum(b.num_rows for b in jaccard._block_pairs(bands)(iter([batch]))) <= n


def test_dense_blocks_at_the_pipelines_threshold():
    bands, sets = jaccard.Bands(80), [jaccard.shingles(t, 1) for _, t in close_texts()]
    n = len(sets)
    cols = {"task": [1] * n, "doc_id": list(range(n)), "comp": list(range(n)), "block": [0] * n}
    batch = pa.RecordBatch.from_pydict(cols | {"size": [len(x) for x in sets], "sketch": [bands.sketch(x).tobytes() for x in sets]})
    assert 1 <= sum(b.num_rows for b in jaccard._block_pairs(bands)(iter([batch]))) <= n
    batch = pa.RecordBatch.from_pydict(cols | {"set": [x.tobytes() for x in sets]})
    assert sum(b.num_rows for b in jaccard._block_links(bands)(iter([batch]))) == n - 1


@pytest.mark.parametrize(("block", "elements"), [(2048, 2_000_000), (30, 2_000_000), (2048, 3000)])
def test_classes_of_dense_blocks(spark, monkeypatch, block, elements):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "ELEMENTS", elements, raising=False)
    rows = close_texts()
    got = {r.doc_id: r.component_id for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string"), n=1).collect()}
    assert got == jaccard.brute_classes(rows, 1) and 50 < len(set(got.values())) < 150


def test_components_of_a_chain(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101)], "a long, b long")
    got = {r.doc_id: r.component for r in jaccard.components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, n + 1)) and got[101] == 100


def test_components_of_a_small_table_take_no_shuffle(spark, monkeypatch):
    written, stored = [], jaccard.stored

    def seen(df, label):
        written.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, label)

    monkeypatch.setattr(jaccard, "stored", seen)
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r.component for r in jaccard.components(edges).collect()} == {0}
    assert len(written) == 1 and "Exchange" not in written[0]


@pytest.mark.parametrize("small", [0, 20, 500_000])
def test_components_of_any_size(spark, monkeypatch, small):
    monkeypatch.setattr(jaccard, "SMALL", small, raising=False)
    r = random.Random(5)
    pairs = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(7, 7), (200, 100), (100, 200), (200, 300)]
    least = {v: v for p in pairs for v in p}
    for _ in least:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    got = jaccard.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert sorted((x.doc_id, x.component) for x in got) == sorted((v, m) for v, m in least.items() if v != m)
    assert jaccard.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_classes_with_distributed_components(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 0, raising=False)
    rows = corpus(6, 30)
    got = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == jaccard.brute_classes(rows)


def test_only_signatures_where_classes_meet_are_kept(spark):
    members = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (2, 12), (3, 12), (3, 13), (3, 14)], "sig long, doc_id long")
    tied = spark.createDataFrame([(11, 10), (12, 10), (14, 13)], "doc_id long, component long")
    kept = jaccard._meeting(members, tied)
    assert sorted(tuple(r) for r in kept.select("sig", "doc_id", "comp", "first").collect()) == [(3, 12, 10, 10), (3, 13, 13, 10), (3, 14, 13, 10)]
    assert sorted(tuple(r) for r in jaccard._between(kept).collect()) == [(12, 13), (12, 14)]


def test_odd_rows(spark, odd_docs, no_docs):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(odd_docs).collect()]
    assert len(got) == 10
    assert (1, 0, 1) in got and (4, 1, 4) in got and got.count((6, 7, 6)) == 2 and (7, 7, 6) in got and (5, 1, 5) in got
    assert jaccard.classes(no_docs).count() == 0
    kept = [r.doc_id for r in jaccard.keep_one(odd_docs).collect()]
    assert 7 not in kept and kept.count(6) == 2 and None in kept


def test_query(spark):
    from graphspark.llm.queries import op3_jaccard_classes

    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert {r.doc_id: r.component_id for r in op3_jaccard_classes(spark, "/root/testdata/sf0.001").collect()} == jaccard.brute_classes(docs)
