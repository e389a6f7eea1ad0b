from __future__ import annotations

from graphspark.llm import decontam, jaccard, mixing, quality, sharding


def test_stages_take_effect_on_all_that_was_kept(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = {}
    frame = docs
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
        out = stage(spark, frame, folder)
        ids = [r.doc_id for r in out.collect()]
        if name == "quality rules":
            assert sorted(ids) == sorted(r.doc_id for r in quality.judge(frame).collect() if r.kept)
        elif name == "n-gram jaccard join":
            classes = jaccard.brute_classes(before, 5, 80)
            assert sorted(ids) == sorted(i for i, c in classes.items() if i == c)
        elif name == "benchmark decontamination":
            bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            hit = {d for d, _ in decontam.brute_pairs([b for b in before if len(b[1]) < 6000], bench)}
            assert sorted(ids) == sorted(i for i, t in before if i not in hit)
        elif name == "mixing":
            copies = {r.doc_id: r.copies for r in mixing.plan(frame).collect()}
            assert {i: ids.count(i) for i in set(ids)} == {i: n for i, n in copies.items() if n}
        else:
            table = sharding.lookup_table(sharding.shard_names(64), 10_007)
            assert len(ids) == len(before) and all(r.shard == table[r.slot] for r in out.collect())
        assert out.columns[: len(columns)] == columns and (name == "sharding" or len(out.columns) == len(columns))
        kept[name], frame = len(ids), out
    assert 0 < kept["benchmark decontamination"] <= kept["n-gram jaccard join"] <= kept["quality rules"] < docs.count()


def test_run_is_the_stages_one_after_the_other(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, folder)
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, folder)
    assert sorted(map(str, got.collect())) == sorted(map(str, frame.collect()))


def test_empty_corpus(spark, no_docs):
    import corpus_pipeline

    frame = no_docs
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, "/root/testdata/sf0.001")
    assert frame.count() == 0
