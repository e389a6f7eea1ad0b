from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest

from graphspark.llm import classifier, quality, stats


def test_counts_against_their_definitions():
    r = random.Random(0)
    for _ in range(3000):
        text = "".join(r.choice("ab é\n #*  \x0b\x1f a b") for _ in range(r.randint(0, 120)))
        assert stats.text_counts(text)[:5] == stats.brute_counts(text)


def test_counts_as_they_stand():
    assert stats.text_counts("a b c d e\na b c d e\nx # y")[:5] == [13, 13, 1, 1, 10]
    assert stats.text_counts("") == [0] * len(stats.COUNTS)


def test_consistency_factor():
    z = np.random.default_rng(0).standard_normal((200_000, 6))
    near = np.argsort((z**2).sum(1))[:150_000]
    assert abs(quality.consistency(0.75, 6) - 1 / z[near].var()) < 0.01


def test_estimates_are_robust_and_near_the_plain_algorithm(spark):
    r = np.random.default_rng(1)
    z = np.concatenate([r.normal(0.5, 0.1, (900, 6)), r.normal(3.0, 0.05, (100, 6))])
    rows = [("en", "a", 100, 0, [float(x) for x in v]) for v in z]
    frame = spark.createDataFrame(rows, "lang string, source string, n_words long, n_repeat_words long, z array<double>")
    grouped = quality.grouped(frame, 100)
    est = quality.estimates(grouped, 0.75, 2).collect()
    assert len(est) == 1
    mu, inv = np.array(est[0].mu), np.array(est[0].inv).reshape(6, 6)
    assert abs(mu - 0.5).max() < 0.03
    d = np.einsum("ij,jk,ik->i", z - mu, inv, z - mu)
    plain = quality.brute_distances(z, 0.75, 4)
    assert d[900:].min() > 110 and d[:900].max() < 60
    assert np.allclose(d[:900], plain[:900], rtol=0.2, atol=0.8)


def test_small_groups_fall_back(spark):
    rows = [("en", f"s{i % 30}", 100, 0, [0.0] * 6) for i in range(60)] + [("fr", "x", 100, 0, [0.0] * 6)] + [(None, None, 100, 0, [0.0] * 6)] * 70
    frame = spark.createDataFrame(rows, "lang string, source string, n_words long, n_repeat_words long, z array<double>")
    groups = {(r.lang, r.grp) for r in quality.grouped(frame, 50).collect()}
    assert groups == {("en", '{"lang":"en"}'), ("fr", "all"), (None, "{}")}


def test_fallbacks_use_all_rows_of_the_language_and_table(spark):
    r = np.random.default_rng(3)
    row = lambda lang, source, at: (lang, source, 100, 0, [float(x) for x in r.normal(at, 0.1, 6)])
    rows = [row("en", "hot", 0.5) for _ in range(200)] + [row("en", None, 0.5) for _ in range(150)] + [row("en", f"s{i}", 3.0) for i in range(3)] + [row("fr", "x", 3.0) for _ in range(2)]
    frame = spark.createDataFrame(rows, "lang string, source string, n_words long, n_repeat_words long, z array<double>")
    est = {e.grp: np.array(e.mu) for e in quality.estimates(quality.grouped(frame, 100), 0.75, 2).collect()}
    assert len(est) == 4 and all(abs(mu - 0.5).max() < 0.05 for mu in est.values())


def test_junk_in_a_small_source_is_judged_by_its_language(spark):
    rows = duckdb.sql("SELECT d.text FROM '/root/testdata/sf0.01/documents.parquet' d JOIN '/root/testdata/sf0.01/labels.parquet' l USING (doc_id) WHERE quality = 1 AND lang = 'en' ORDER BY doc_id LIMIT 150").fetchall()
    junk = " ".join(f"###{k} $$ x{k}% || <{k}> **" for k in range(8))
    for source in ("rare", "hot"):
        docs = spark.createDataFrame([(i, t, "en", "hot") for i, (t,) in enumerate(rows)] + [(1000 + i, f"{junk} {i}", "en", source) for i in range(3)], "doc_id long, text string, lang string, source string")
        got = {r.doc_id: r for r in quality.judge(docs).collect()}
        assert all(got[i].base_failed or got[i].distance > 120 and not got[i].kept for i in (1000, 1001, 1002))
        assert not got[1000].base_failed
        assert sum(got[i].kept or got[i].base_failed for i in range(len(rows))) == len(rows)


def test_the_start_with_the_smallest_determinant_goes_on(spark):
    """A group whose median start lies between two clusters: the result is the larger one."""
    r = np.random.default_rng(5)
    z = np.concatenate([r.normal(0.2, 0.05, (520, 6)), r.normal(2.0, 0.6, (480, 6))])
    frame = spark.createDataFrame([("en", "a", 100, 0, [float(x) for x in v]) for v in z], "lang string, source string, n_words long, n_repeat_words long, z array<double>")
    est = quality.estimates(quality.grouped(frame, 100), 0.5, 2).collect()
    assert abs(np.array(est[0].mu) - 0.2).max() < 0.05


def test_rows(spark, odd_docs, no_docs):
    got = quality.judge(odd_docs).collect()
    assert len(got) == 10
    by = {r.doc_id: r for r in got}
    assert by[1].n_words == 0 and by[1].base_failed and not by[1].kept
    assert by[5].base_failed and by[5].n_repeat_words == 30_000
    assert by[6].kept and not by[6].base_failed
    assert quality.judge(no_docs).count() == 0
    assert sorted(r.doc_id for r in quality.keep_good(odd_docs).collect() if r.doc_id) == [6, 6, 7]


def test_query_rejects_junk_and_keeps_the_rest(spark):
    from graphspark.llm.queries import op4_quality_rules

    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    good = bad = kept_good = kept_bad = 0
    for r in op4_quality_rules(spark, folder).collect():
        want = stats.brute_counts(docs[r.doc_id]) if len(docs[r.doc_id]) < 3000 else None
        if want:
            assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == want
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        if r.doc_id in marks and not r.base_failed:
            if marks[r.doc_id]:
                good, kept_good = good + 1, kept_good + r.kept
            else:
                bad, kept_bad = bad + 1, kept_bad + r.kept
    assert kept_good == good and kept_bad <= 0.2 * bad


def test_rules_find_a_conjunction():
    r = np.random.default_rng(0)
    x = {"a": r.random(4000), "b": r.random(4000), "c": r.random(4000)}
    y = ((x["a"] > 0.6) & (x["b"] <= 0.4)).astype(int)
    model = classifier.fit_rules(x, y, trees=10)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.98
    assert len(model.rules) < 60
    names = {n for rule, _ in model.rules for n, _, _ in rule}
    assert {"a", "b"} <= names


def test_no_rule_is_cut_before_the_lasso():
    r = np.random.default_rng(4)
    x = {n: r.random(6000) for n in "abcdefgh"}
    y = (sum(np.sin(9 * v) for v in x.values()) > 0).astype(int)
    assert len(classifier.grow_rules(x, y.astype(float), 40, 3)) > 250
    seen = []
    keep, classifier.lasso_logistic = classifier.lasso_logistic, lambda a, *rest: (seen.append(a.shape[1]), (0.0, np.zeros(a.shape[1])))[1]
    try:
        classifier.fit_rules(x, y, trees=40)
    finally:
        classifier.lasso_logistic = keep
    assert seen[0] > 250


def test_contradicting_labels(spark, odd_docs):
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (6, 1, 0), (6, 1, 0), (6, 0, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    assert {tuple(r) for r in classifier.score_quality(odd_docs, labels).collect()} == {tuple(r) for r in classifier.score_quality(odd_docs, labels.orderBy("quality")).collect()}


def test_one_class_and_no_labels():
    assert classifier.fit_rules({"a": np.arange(5.0)}, np.ones(5, int)).rules == ()
    assert classifier.fit_rules({"a": np.zeros(0)}, np.zeros(0, int)).score({"a": np.zeros(1)})[0] == 0.5


def test_compiled_column_scores_as_the_model(spark):
    r = np.random.default_rng(2)
    x = {"a": r.random(500), "b": r.random(500)}
    model = classifier.fit_rules(x, ((x["a"] > 0.5) & (x["b"] > 0.3)).astype(int), trees=5)
    frame = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x["a"], x["b"]))], "i int, a double, b double")
    got = [row.s for row in frame.select("i", model.column().alias("s")).orderBy("i").collect()]
    assert np.allclose(got, model.score(x))


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_held_out_accuracy(spark, folder):
    import zlib

    from graphspark.llm.queries import op5_quality_score

    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = op5_quality_score(spark, folder).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in marks]
    assert sum(r.predicted == marks[r.doc_id] for r in held) / len(held) > 0.9


def test_scores_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 0, 0), (6, 1, 0), (8, 1, None), (9, None, 1)], "doc_id long, quality int, toxic int")
    assert classifier.score_quality(odd_docs, labels).count() == 10
    assert classifier.score_quality(odd_docs, labels.where("false")).count() == 10
    assert classifier.score_quality(no_docs, labels).count() == 0
