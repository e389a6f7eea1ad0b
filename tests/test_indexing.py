"""Texts, resolution, corrections, diagnostics and planning on fixtures."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from graphspark.functions import names, similarity
from graphspark.functions.props import bag, literal
from graphspark.model import BAG, EntityType, Property, Vocabulary
from graphspark.operators import corrections, extraction, planning, resolve, search, text


def test_names(spark):
    cases = {"worksOn": "WORKS_ON", "works-on": "WORKS_ON", "WORKS_ON": "WORKS_ON", "Works On": "WORKS_ON", "HTMLParser": "HTML_PARSER", "a.b": "A_B", "componentOf": "COMPONENT_OF"}
    rows = spark.createDataFrame(list(cases.items()), "name string, want string").select("want", names.screaming_snake(F.col("name")).alias("got")).collect()
    assert all(r.want == r.got for r in rows)
    one = spark.createDataFrame([(" My-Type. x!", "person", "  Zoë & Co ")], "a string, b string, c string")
    r = one.select(names.type_name(F.col("a")).alias("a"), names.entity_slug(F.col("b"), F.col("c")).alias("b"), names.label_key(F.lit("Café /  Bar")).alias("c")).first()
    assert (r.a, r.b, r.c) == ("my_type_x", "person:zo-co", "cafe/bar")


def test_hash(spark):
    def model(s):
        h = 0
        for ch in s:
            h = (h * 31 + ord(ch)) & 0xFFFFFFFF
        return h - (1 << 32) if h >= 1 << 31 else h

    r = random.Random(0)
    words = ["".join(r.choice("abcXYZ:é1") for _ in range(r.randint(0, 30))) for _ in range(100)]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", names.hash32(F.col("w")).alias("h")).collect()
    assert all(x.h == model(x.w) for x in got)


def test_strings():
    jw = similarity.jaro_winkler_of
    assert abs(jw("MARTHA", "MARHTA") - 0.9611) < 1e-4 and abs(jw("DIXON", "DICKSONX") - 0.8133) < 1e-4
    assert jw("", "") == 1.0 and jw("a", "") == 0.0 and jw("abc", "xyz") == 0.0 and jw("x", "x") == 1.0


def test_chapters(spark):
    one = lambda doc: spark.createDataFrame([(1, doc)], "doc_id long, text string")
    chapters = lambda doc, most=30_000: [tuple(r)[1:] for r in text.split_chapters(one(doc), most).orderBy("index").collect()]
    doc = "intro\n# One\na\n## Sub\nb\n# Two\nc"
    assert chapters(doc) == [(0, "Preamble", 0, 1, 7, doc)]
    small = chapters(doc, 12)
    assert [c[1] for c in small] == ["Preamble", "# One", "## Sub", "# Two"]
    assert "\n".join(c[5] for c in small) == doc
    assert chapters("no headings\nat all") == [(0, "Document", 0, 1, 2, "no headings\nat all")] and chapters(None)[0][5] == ""
    long = "# A\n" + "\n".join("line %d" % i for i in range(100)) + "\n# B\nend"
    parts = chapters(long, 200)
    assert "\n".join(c[5] for c in parts) == long and all(len(c[5]) <= 200 for c in parts) and parts[1][1] == "# A (continued)"
    assert [c[1:] for c in chapters("pre\n\n\n# A\nb\n# C", 6)] == [("Preamble", 0, 1, 3, "pre"), ("# A", 1, 4, 5, "# A\nb"), ("# C", 1, 6, 6, "# C")]
    marks = "# a\nx\n===\n-- 1 of 2 --\n\n\n### b\n  # code\ny\n---\n# q\n---"
    got = [(r.line, r.priority, r.heading) for r in text.marked_lines(one(marks)).collect()]
    assert got == [(1, 30, "# a"), (2, 30, "# x"), (4, 15, "-- 1 of 2 --"), (6, 5, ""), (7, 10, "### b"), (9, 20, "## y"), (11, 30, "# q")]
    assert text.is_structured(one(marks)).first().structured and not text.is_structured(one("a\nb")).first().structured
    o = text.overview(text.split_chapters(one(doc), 12), spark.createDataFrame([(1, "x/y.md")], "doc_id long, path string")).first()
    assert (o.title, o.structure, o.chapters) == ("One", "One\n  Sub\nTwo", 4)


def test_chunks():
    lines = [f"line {i}" for i in range(50)]
    got = text.chunks("\n".join(lines), 100, 20)
    assert got[0][2].startswith("1\tline 0") and all(b[1] > a[1] for a, b in zip(got, got[1:]))
    seen = {int(x.split("\t")[0]) for c in got for x in c[2].split("\n")}
    assert seen == set(range(1, 51))
    assert int(got[1][2].split("\t")[0]) <= int(got[0][2].split("\n")[-1].split("\t")[0])


def test_lines(spark):
    docs = spark.createDataFrame([(1, "# A\nfoo\n## B\nbar foo\n# C\nend"), (2, "")], "doc_id int, text string")
    assert [(r.line, r.content) for r in text.read_lines(docs, 2, 3).orderBy("doc_id", "line").collect()] == [(2, "foo"), (3, "## B")]
    hits = text.grep(docs, "FOO", 1).orderBy("line").collect()
    assert [(r.line, r.context) for r in hits] == [(2, "# A\nfoo\n## B"), (4, "## B\nbar foo\n# C")]
    assert text.grep(docs, "(foo").count() == 0
    assert [(r.heading, r.section_end) for r in text.headings(docs).orderBy("line").collect()] == [("A", 4), ("B", 4), ("C", None)]
    assert [r.content for r in text.read_section(docs, "b").orderBy("line").collect()] == ["## B", "bar foo"]
    assert docs.select(text.span_text(F.col("text"), F.lit(2), F.lit(3)).alias("t")).first().t == "foo\n## B"


def test_salvage():
    whole = {"entities": [{"label": "a{"}, {"label": "b"}], "relationships": [{"type": "x"}]}
    s = json.dumps(whole)
    assert json.loads(text.salvage(s)) == whole and json.loads(text.salvage(f"<think>hm</think>\n```json\n{s}\n```")) == whole
    cut = json.loads(text.salvage(s[: s.index('"b"')]))
    assert cut == {"entities": [{"label": "a{"}], "relationships": []}
    assert text.salvage("nothing") is None and text.salvage(None) is None and text.salvage('{"a": 1}') is None


def test_tables():
    doc = "x\n| a | b |\n|---|---|\n| 1 | 2 |\n| 3 |\n\ny\n"
    (line, rows), = text.markdown_tables(doc)
    assert line == 2 and rows == [["a", "b"], ["1", "2"], ["3"]]
    clean = [(1, [["a", "b", "c"], ["1", "2", "3"]])]
    assert text.table_verdict(clean)[0] == "clean" and text.table_verdict(clean, [14])[0] == "corrupt" and text.table_verdict(clean, [3, 3])[0] == "suspect"


def candidates(spark, rows):
    f = spark.createDataFrame([(t, o, label, s, a) for t, o, label, s, a in rows], "type string, ord long, label string, source string, aliases array<string>")
    return f.withColumn("summary", F.lit("s")).withColumn("properties", bag(n=literal(1)).cast(BAG))


def test_consolidation(spark):
    c = candidates(spark, [("E", 1, "Komatsu 930E", "d1", ["930E"]), ("E", 2, "Cat 793F", "d1", []), ("E", 3, "Komatsu 930E-4", "d2", ["930E", "Komatsu 930E"]), ("F", 4, "930E", "d2", []), ("E", 5, "x", "d2", ["y"]), ("E", 6, "z", "d2", ["w"]), ("E", 7, "q", "d3", ["w", "y"])])
    one = {r.ord: r.canonical for r in resolve.merge_candidates(c).collect()}
    assert one == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 6, 7: 5}
    tied = {r.ord: r.canonical for r in resolve.connected_candidates(c).collect()}
    assert tied == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 5, 7: 5}
    m = {r.canonical: r for r in resolve.merged(c, resolve.merge_candidates(c)).collect() if r.type == "E"}
    assert m[1].n == 2 and m[1].label == "Komatsu 930E" and m[1].source_documents == ["d1", "d2"] and "Komatsu 930E-4" in m[1].aliases
    assert resolve.merge_log(c, resolve.merge_candidates(c)).count() == 2


def test_long_chains_join(spark):
    names = [("T", i, f"n{i}", [f"n{i + 1}"]) for i in range(70)] + [("U", i, f"n{i}", [f"n{i + 1}"]) for i in (3, 4, 6)]
    c = spark.createDataFrame(names, "type string, ord long, label string, aliases array<string>")
    tied = {(r.type, r.ord): r.canonical for r in resolve.connected_candidates(c).collect()}
    assert tied == {("T", i): 0 for i in range(70)} | {("U", 3): 3, ("U", 4): 3, ("U", 6): 6}


def test_registry(spark):
    reg = spark.createDataFrame([("1", "E", "Komatsu 930E", ["930E", "930E-4"]), ("2", "E", "Cat 793F", ["793F"]), ("3", "Fluid", "SAE 15W-40", [])], "id string, type string, label string, aliases array<string>")
    rows = spark.createDataFrame([(1, "E", "komatsu 930e"), (2, "E", "793f"), (3, "E", "Komatsu 930F"), (4, "E", "SAE 15W-40"), (5, "E", "nothing")], "key int, type string, label string")
    got = {r.key: (r.entry, r.matched_by) for r in resolve.match_registry(rows, reg).collect()}
    assert got == {1: ("1", "slug"), 2: ("2", "alias"), 3: ("1", "fuzzy"), 4: (None, None), 5: (None, None)}


def test_registry_reaches_half_the_length(spark):
    from graphspark.functions.similarity import jaro_winkler_of

    word = "abcdefghijklmnopqrstuvwxyz0123456789" * 3
    pairs = [(n, m) for n in (3, 6, 9, 17, 19, 34, 36) for m in range(n + 1, 2 * n + 2)]
    rows = spark.createDataFrame([(k, f"T{k}", word[:n]) for k, (n, m) in enumerate(pairs)] + [(-1, "E", "engine")], "key int, type string, label string")
    reg = spark.createDataFrame([(str(k), f"T{k}", word[:m], []) for k, (n, m) in enumerate(pairs)] + [("e", "E", "engineering", [])], "id string, type string, label string, aliases array<string>")
    for threshold in (0.9, 0.8):
        got = {r.key for r in resolve.match_registry(rows, reg, threshold).collect() if r.entry is not None}
        assert got == {k for k, (n, m) in enumerate(pairs) if jaro_winkler_of(word[:n], word[:m]) >= threshold} | {-1}


def test_few_pairs_are_compared_in_full(monkeypatch):
    import random

    from graphspark.functions.similarity import jaro_winkler_of

    r, calls = random.Random(4), []
    words = ["large ring", "hot bolt", "blue ring", "old plate", "cold plate", "é grün", "αβγ"]
    entries = [f"{r.choice(words)} {r.randrange(3000)}" for _ in range(500)] + ["", "a", "a"]
    names = [r.choice([e + "x", e[::-1], e[1:], "alias-" + e[-2:], e]) for e in r.sample(entries, 120)] + ["", "a"]
    monkeypatch.setattr(resolve, "jaro_winkler_of", lambda a, b: calls.append(1) or jaro_winkler_of(a, b))
    for threshold in (0.9, 0.6):
        calls.clear()
        got = resolve._best_entries(names, entries, threshold)
        for name, b in zip(names, got):
            c, j = max((jaro_winkler_of(name, e), -j) for j, e in enumerate(entries))
            assert b == ((-j, c) if c >= threshold else None)
        assert len(calls) < len(names) * len(entries) / 5


def test_registry_in_blocks(spark, monkeypatch):
    reg = spark.createDataFrame([(str(i), f"T{i % 2}", f"engine part {i}", []) for i in range(40)] + [("x", "T0", None, [])], "id string, type string, label string, aliases array<string>")
    rows = spark.createDataFrame([(i, f"T{i % 2}", f"engine part {i}x") for i in range(50)] + [(99, "T0", None), (98, "none", "engine")], "key int, type string, label string")
    seen = lambda: sorted(map(tuple, resolve.match_registry(rows, reg).select("key", "entry", "confidence").collect()), key=str)
    whole = seen()
    assert len(whole) == 52 and sum(e is not None for _, e, _ in whole) == 50
    monkeypatch.setattr(resolve, "BLOCK", 7, raising=False)
    assert seen() == whole


def test_registry_builds_no_broadcast_of_rows_or_entries(spark, monkeypatch):
    reg = spark.range(300).selectExpr("id", "concat('T', id % 2) AS type", "concat('engine part ', id) AS label", "array(concat('alias-', id % 3)) AS aliases")
    rows = spark.range(300).selectExpr("id AS key", "concat('T', id % 2) AS type", "CASE id % 3 WHEN 0 THEN concat('Engine-part-', id) WHEN 1 THEN concat('ALIAS-', id % 6 % 3) ELSE concat('engine part ', id, 'x') END AS label")
    plans, write = [], resolve.stored
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(resolve, "stored", lambda df, label: plan(df) or write(df, label))
    monkeypatch.setattr(resolve, "BROADCAST_ROWS", 0, raising=False)
    got = resolve.match_registry(rows, reg)
    seen = got.groupBy("matched_by").count().collect()
    plan(got)
    assert {r.matched_by: r["count"] for r in seen} == {"slug": 100, "alias": 100, "fuzzy": 100}
    assert not [x for x in plans if "BroadcastHashJoin" in x or "BroadcastNestedLoopJoin" in x]


def test_best_entries_are_those_of_all_pairs():
    import random

    from graphspark.functions.similarity import jaro_winkler_of

    r = random.Random(5)
    for letters, most in (("ab", 6), ("0123456789xyz ", 20), ("αβ é🙂", 64), ("abcdef", 90), ("".join(map(chr, range(0x4E00, 0x5400))), 12)):
        word = lambda: "".join(r.choice(letters) for _ in range(r.randrange(most + 1)))
        entries = [word() for _ in range(30)]
        entries += [e[:2] + e[3:] for e in entries] + entries[:5]
        names = [r.choice([e + "x", e[::-1], e[1:2] + e[:1] + e[2:], e[:3] + word()]) for e in entries] + ["", "a"]
        for threshold in (0.95, 0.8, 0.3):
            got = resolve._best_entries(names, entries, threshold)
            for name, b in zip(names, got):
                c, j = max((jaro_winkler_of(name, e), -j) for j, e in enumerate(entries))
                assert b == ((-j, c) if c >= threshold else None)


def test_registry_query_covers_all_parts(spark):
    from graphspark import catalogue

    got = catalogue.queries()["registry_match"](spark, "/root/testdata/sf0.01")
    assert got.count() == got.select("key").distinct().count() == spark.read.parquet("/root/testdata/sf0.01/part.parquet").count()


def test_relationship_resolution(spark):
    e = spark.createDataFrame([("a", "P", "Alice", ["Al"]), ("b", "C", "Acme", []), ("c", "P", "Acme", [])], "id string, type string, label string, aliases array<string>")
    r = spark.createDataFrame([(1, "WORKS_AT", "al", "acme"), (2, "WORKS_AT", "Alice", "ACME"), (3, "WORKS_AT", "bob", "acme")], "ord long, type string, source_label string, target_label string").withColumn("properties", F.create_map().cast(BAG))
    got = resolve.resolve_relationships(r, e, {"WORKS_AT": (("P",), ("C",))})
    assert {x.ord: (x.source_id, x.target_id) for x in got.collect()} == {1: ("a", "b"), 2: ("a", "b"), 3: (None, "b")}
    assert [(x.ord, x.n) for x in resolve.deduplicated(got).collect()] == [(1, 2)]


def base():
    return corrections.Extraction([{"label": "A", "type": "T", "properties": {"x": 1}}, {"label": "B", "type": "T"}, {"label": "C", "type": "T"}], [{"type": "R", "source": "A", "target": "B"}, {"type": "R", "source": "A", "target": "C"}])


def test_corrections():
    run = lambda *c: corrections.replay(base(), list(c))
    key = {"type": "R", "source": "a", "target": "b"}
    x, rep = run({"item": "entity", "operation": "update", "label": "a", "property": "x", "value": 2}, {"item": "entity", "operation": "remove-property", "label": "A", "property": "x"})
    assert x.entities[0]["properties"] == {} and [r[1] for r in rep] == ["applied", "applied"]
    x, _ = run({"item": "entity", "operation": "delete", "label": "B"})
    assert len(x.entities) == 2 and len(x.relationships) == 1
    x, rep = run({"item": "relationship", "operation": "retarget", "key": key, "endpoint": "target", "new_label": "C"})
    assert len(x.relationships) == 1 and rep[0][1] == "applied"
    new = {"label": "D", "type": "T", "refs": [1]}
    group = [{"item": "entity", "operation": "delete", "label": "C", "group": "g"}, {"item": "entity", "operation": "create", "value": new, "group": "g"}, {"item": "relationship", "operation": "retarget", "key": key, "endpoint": "target", "new_label": "D", "group": "g"}]
    x, rep = run(*group)
    assert [e["label"] for e in x.entities] == ["A", "B", "D"] and [(r["source"], r["target"]) for r in x.relationships] == [("A", "D")]
    x, rep = run(*group, {"item": "entity", "operation": "delete", "label": "nobody", "group": "g"})
    assert x == base() and {r[1] for r in rep} == {"failed"}
    assert run({"item": "entity", "operation": "create", "value": {"label": "a", "refs": [1]}})[1][0][1] == "failed"
    x, rep = run({"item": "entity", "operation": "update", "label": "A", "property": "label", "value": "Z"})
    assert {r["source"] for r in x.relationships} == {"Z"}


def test_corrections_by_source(spark):
    x = spark.createDataFrame([("s", json.dumps(base().__dict__)), ("t", json.dumps(base().__dict__))], "source string, extraction string")
    c = spark.createDataFrame([("s", 1, json.dumps({"item": "entity", "operation": "delete", "label": "B"}))], "source string, ord int, correction string")
    got = {r.source: len(json.loads(r.extraction)["entities"]) for r in corrections.apply_corrections(x, c).collect()}
    assert got == {"s": 2, "t": 3}


def test_token_subsets(spark):
    rows = [("s", "T", x) for x in ("Cat 793F Truck", "Cat 793F", "cat", "Dog", "793F truck", "Cat-793F Truck")]
    got = extraction.token_subsets(spark.createDataFrame(rows, "source string, type string, label string")).collect()
    words = lambda s: set(s.lower().replace("-", " ").split())
    labels = [r[2] for r in rows]
    assert sorted((r["sub"], r["sup"]) for r in got) == sorted((a, b) for a in labels for b in labels if words(a) < words(b))


def test_ranges_and_verdicts(spark):
    row = lambda label, **p: spark.range(1).select(F.lit("s").alias("source"), F.lit("E").alias("type"), F.lit(label).alias("label"), bag(**{k: literal(v) for k, v in p.items()}).cast(BAG).alias("properties"))
    f = row("a", w="1,234 kg", q=2.5, f=130).union(row("b", w="heavy", q=3, f=90)).union(row("c", w=5, q=200))
    rules = [extraction.Range("E", "w", "number", 0.1, 1000), extraction.Range("E", "q", "integer", 1, 100), extraction.Range("E", "f", "percentage")]
    got = sorted((r.label, r.property, r.code) for r in extraction.range_issues(f, rules).collect())
    assert got == [("a", "f", "percentage"), ("a", "q", "not-integer"), ("a", "w", "above"), ("b", "w", "not-numeric"), ("c", "q", "above")]
    sources = spark.createDataFrame([("s",), ("t",)], "source string")
    judged = extraction.verdicts(sources, extraction.range_issues(f, rules))
    assert {r.source: r.verdict for r in judged.collect()} == {"s": "fail", "t": "pass"}
    assert extraction.checkpoint(judged).first().verdict == "fail" and extraction.checkpoint(judged.where("source = 't'")).first().verdict == "pass"
    low = spark.createDataFrame([("t", 0.5)], "source string, accuracy double")
    assert extraction.checkpoint(judged.where("source = 't'"), low).first().verdict == "fail"


def test_conformance(spark):
    v = Vocabulary((EntityType("E", properties=(Property("k", "enum", values=("x", "y")),)),))
    f = spark.createDataFrame([("s", "E", f"l{i}", c) for i, c in enumerate("xzzq")], "source string, type string, label string, c string").withColumn("properties", F.create_map(F.lit("k"), F.struct(F.col("c").alias("s"), F.lit(None).cast("double").alias("d"), F.lit(None).cast("boolean").alias("b"), F.lit(None).cast("string").alias("j"))))
    assert [(r["class"], r.n, r.examples) for r in extraction.class_counts(extraction.conformance(f, v)).collect()] == [("closed-enum-value", 3, "l1|l2|l3")]
    assert [(r.value, r.n) for r in extraction.enum_offenders(f, v).collect()] == [("z", 2)]


def test_planning(spark):
    assert planning.weighted_ranges(10, [1, 1, 1]) == [(0, 3), (3, 3), (6, 4)]
    assert planning.validation_cost(100, 1.0, 2.0)["cost"] == 0.19
    phase = lambda *s, **k: planning.phase(spark.createDataFrame([(x,) for x in s], "status string"), **k).first().phase
    assert phase() == "prepare" and phase("excluded") == "complete" and phase("validated", "excluded") == "complete"
    assert phase("pending", "converting") == "prepare" and phase("pending", "imported") == "extract" and phase("extracted") == "extraction-review"
    assert phase("consolidated") == "consolidate" and phase("consolidated", archives=True) == "import" and phase("imported", "validated") == "import"
    rows = spark.createDataFrame([(f"{i:03d}",) for i in range(10)], "id string")
    assert [r["count"] for r in planning.assign_ranges(rows, [1, 1]).groupBy("worker").count().orderBy("worker").collect()] == [5, 5]
    w = spark.createDataFrame([("a", ["x"], 10, 1.0, 1.0, 0), ("b", ["x"], 20, 5.0, 5.0, 1), ("c", ["x", "y"], 20, 2.0, 2.0, 2)], "name string, capabilities array<string>, context_window int, input_cost double, output_cost double, ord int")
    f = spark.createDataFrame([("s", "a", ["a"], "context length"), ("t", "b", ["b"], "context length"), ("u", "b", ["b"], "weird")], "source string, worker string, tried array<string>, error string")
    assert {r.source: r.next_worker for r in planning.reassign(f, w).collect()} == {"s": "c", "t": None, "u": "c"}


def test_search(spark):
    f = spark.createDataFrame([("1", "Meeting Notes"), ("2", "Code Review"), ("3", "Alice Smith")], "id string, label string")
    assert [r.id for r in search.keyword_search(f, F.lower("label"), "notes code review", 5).collect()] == ["2", "1"]
    vectors = f.withColumn("embedding", search.embedder()(F.col("label")))
    best = search.concept_search(vectors, search.hash_embedding("Code Review"), 0.9, 1).collect()
    assert best[0].id == "2" and abs(best[0].score - 1) < 1e-6
    assert search.concept_search(vectors, [0.0] * 8, 0.5).count() == 0 and search.concept_search(vectors, [1.0], 0.5).count() == 0
    assert f.select(search.highlight(F.lit("a" * 60 + "needle" + "b" * 60), "x needle").alias("h")).first().h == "..." + "a" * 40 + "needle" + "b" * 40 + "..."


@pytest.mark.parametrize("n", [1, 3])
def test_context(spark, n):
    rows = spark.createDataFrame([("s", f"e{i}", i, "x" * 9) for i in range(8)], "source string, name string, last_seen int, text string")
    assert [r.name for r in planning.recent_context(rows, 7, 6, 10 * n).orderBy(F.desc("last_seen")).collect()] == [f"e{7 - i}" for i in range(n)]


@pytest.mark.parametrize("name", ["orphan_rate", "shared_citation", "zero_property_endpoints", "tier1_schema", "tier1_structure", "relationship_dedup", "resolve_relationships", "import_waves"])
def test_all_lineitems_take_part(spark, name):
    """Against the registered SQL, on larger tables than the rest of the tests."""
    import duckdb

    from graphspark import catalogue

    folder = "/root/testdata/sf0.01"
    db = duckdb.connect()
    for t in ("lineitem", "part"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = db.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    plain = lambda rows: sorted(tuple("null" if x is None else format(float(x), ".9g") if isinstance(x, float) or type(x).__name__ == "Decimal" else str(x) for x in r) for r in rows)
    assert plain(catalogue.queries()[name](spark, folder).select(*columns).collect()) == plain(want.fetchall())


def test_all_type_names_are_compared(spark):
    from graphspark import catalogue
    from graphspark.functions.similarity import jaro_winkler_of

    folder = "/root/testdata/sf0.01"
    names = {r.p_type for r in spark.read.parquet(f"{folder}/part.parquet").select("p_type").distinct().collect()}
    score = {(a, b): jaro_winkler_of(a, b) for a in names for b in names}
    got = {(r.a, r.b): r.score for r in catalogue.queries()["jaro_winkler_names"](spark, folder).collect()}
    assert got == {p: round(x, 6) for p, x in score.items() if p[0] < p[1]}
    got = {(r.a, r.b): r.score for r in catalogue.queries()["type_dedup"](spark, folder).collect()}
    assert got == {p: round(x, 6) for p, x in score.items() if x >= 0.9}
