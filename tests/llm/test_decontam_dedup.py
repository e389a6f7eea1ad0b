from __future__ import annotations

import itertools
import random

from graphspark.llm import decontam, unit_dedup


def words(r, n, pool=400):
    return [f"t{r.randrange(pool)}" for _ in range(n)]


def test_substitutions_are_tolerated():
    r = random.Random(0)
    items = [(k, " ".join(words(r, r.randint(15, 60), 3000))) for k in range(40)]
    index = decontam.Index.of(items)
    docs, want = [], set()
    for d in range(80):
        item = r.choice(items)
        w = item[1].split()
        for i in range(4, len(w) - 3, 9):  # one in nine replaced
            w[i] = "changed"
        docs.append((d, " ".join(words(r, 50, 3000) + w + words(r, 50, 3000))))
        want.add((d, item[0]))
    found = decontam.overlaps([decontam.tokens(t) for _, t in docs], index, 12, 0.8)
    assert {(docs[f[0]][0], index.items[f[1]]) for f in found} == want


def test_against_all_diagonals(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect() if len(r.text) < 4000]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminations(frame, bench).collect()}
    assert got == decontam.brute_pairs(docs, items) and got
    # the benchmark in several blocks gives the same
    assert {(r.doc_id, r.item_id) for r in decontam.contaminations(frame, bench, block_tokens=200).collect()} == got
    left = {r.doc_id for r in decontam.keep_clean(frame, bench).collect()}
    assert left == {i for i, _ in docs} - {d for d, _ in got}


def test_any_run_with_the_share_counts():
    r = random.Random(1)
    cases = [(14, (8, 9)), (12, (0,)), (12, (11,)), (12, (3, 8)), (15, (4, 9, 12)), (20, (3, 8, 12, 16)), (7, (3,)), (10, (4, 6))]
    docs, items = [], []
    for k, (n, changed) in enumerate(cases):
        w = words(r, n, 10**6)
        items.append((k, " ".join(w)))
        docs.append((k, " ".join(words(r, 30, 10**6) + [f"changed{j}" if j in changed else x for j, x in enumerate(w)] + words(r, 30, 10**6))))
    docs.append((99, " ".join(words(r, 20, 10**6) + [x if j % 3 else "changed" for j, x in enumerate(items[5][1].split())])))  # two of three
    found = decontam.overlaps([decontam.tokens(t) for _, t in docs], decontam.Index.of(items), 12, 0.8)
    assert {(docs[f[0]][0], f[1]) for f in found} == {(k, k) for k in range(len(cases))} == decontam.brute_pairs(docs, items)
    assert all(n >= min(12, cases[i][0]) and same >= 0.8 * n - 1e-9 for _, i, _, n, same in found)


def test_odd_benchmarks(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "same text"), (4, "same text here for two rows the very same text"), (4, "same text here for two rows the very same text")], "item_id long, text string")
    got = decontam.contaminations(odd_docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(6, 3), (7, 3), (6, 4), (7, 4)} and len(got) == 9
    tiny = spark.createDataFrame([(1, "one"), (2, "two three four"), (3, "one three"), (4, "a text but no id")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminations(odd_docs, tiny).collect()} == {(4, 1)}
    assert decontam.contaminations(no_docs, bench).count() == 0
    assert decontam.contaminations(odd_docs, bench.where("false")).count() == 0
    assert sorted(r.doc_id for r in decontam.keep_clean(odd_docs, bench).collect() if r.doc_id) == [1, 2, 3, 4, 5, 8]


def test_all_placements_of_substitutions():
    """Every way to change tokens between the first and the last of an overlap that leaves 80 % of it equal."""
    r = random.Random(7)
    for n, k, want in ((12, 2, 45), (15, 3, 286), (20, 4, None)):
        item = words(r, n, 10**6)
        index = decontam.Index.of([(0, " ".join(item))])
        ways = list(itertools.combinations(range(1, n - 1), k))
        ways = ways if want else r.sample(ways, 400)
        docs = [decontam.tokens(" ".join(words(r, 9, 10**6) + [f"x{j}" if j in w else t for j, t in enumerate(item)] + words(r, 9, 10**6))) for w in ways]
        assert {f[0] for f in decontam.overlaps(docs, index, 12, 0.8)} == set(range(want or 400))


def test_a_poorer_longer_run_hides_no_pair():
    r = random.Random(8)
    item = words(r, 46, 10**6)
    held = [t if k < 12 or 17 <= k < 29 or k >= 34 else f"x{k}" for k, t in enumerate(item)]
    index = decontam.Index.of([(0, " ".join(item))])
    assert len(decontam.overlaps([decontam.tokens(" ".join(held))], index, 12, 0.8)) == 1


def test_units():
    text = "One two. Three!\n\nFour five\n  \nSix"
    cut = lambda kind: [text[a:b] for a, b in unit_dedup.units(text, kind)]
    assert cut("sentence") == ["One two.", "Three!", "Four five", "Six"]
    assert cut("line") == ["One two. Three!", "Four five", "Six"]
    assert cut("paragraph") == ["One two. Three!", "Four five", "Six"]
    assert unit_dedup.without("abcdef", [(1, 3)]) == ("adef", [(0, 1), (3, 6)])


def fixture(seed):
    r = random.Random(seed)
    sentence = lambda n: " ".join(words(r, n, 5000)).capitalize() + "."
    passage = " ".join(sentence(12) for _ in range(5))
    rows = []
    for i in range(60):
        body = [sentence(r.randint(3, 15)) for _ in range(r.randint(1, 12))]
        if r.random() < 0.4:
            body.insert(r.randrange(len(body) + 1), passage)
        rows.append((i * 3 % 61, r.choice([" ", "\n"]).join(body)))
    return rows, passage


def test_against_one_walk(spark):
    rows, passage = fixture(0)
    for passages in (25, None):
        frame = spark.createDataFrame([*rows, rows[3], (None, passage)], "doc_id long, text string").repartition(5)
        got = unit_dedup.dedup(frame, passages).collect()
        want = unit_dedup.brute_dedup(rows, passages)
        assert {r.doc_id: r.text for r in got if r.doc_id is not None} == want
        assert [r.text for r in got if r.doc_id is None] == [passage] and len(got) == 62
        source = dict(rows)
        for r in got:
            if r.doc_id is not None:
                assert "".join(source[r.doc_id][s.start : s.end] for s in r.kept) == r.text
                assert r.changed == bool(r.removed) == (r.longest > 0)
    assert sum(passage in t for t in unit_dedup.brute_dedup(rows).values()) == 1


def test_all_later_lines_go(spark):
    """By the definition: of equal lines only the earliest stays, over the whole table."""
    folder = "/root/testdata/sf0.01"
    seen, want = set(), {}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        want[r.doc_id] = []
        for line in (r.text or "").split("\n"):
            key = " ".join(line.lower().split())
            if key and key not in seen:
                want[r.doc_id].append(line.strip())
                seen.add(key)
    got = {r.doc_id: [x.strip() for x in r.text.split("\n") if x.strip()] for r in unit_dedup.dedup(docs, None).collect()}
    assert got == want


def test_chains_of_short_sentences_stay():
    r = random.Random(5)
    rows = [(i, " ".join(f"{r.choice('abcdefgh')}{r.choice('xyz')}!" for _ in range(60))) for i in range(8)]
    assert unit_dedup.brute_dedup(rows) == dict(rows)
    passage = "Is onhe. " * 60
    assert unit_dedup.brute_dedup([(1, passage), (2, passage)])[2].split() == []


def test_repeated_lines_and_paragraphs_go_whatever_their_length(spark):
    line, stub = "This one line of nine words stands in many", "only four words here"
    table = "a b c d\ne f g h\ni j k l"
    rows = [(1, f"First own text.\n{line}\nMore.\n\n{table}\n"), (2, f"{line}  \n{stub}\nSecond own text.\n{line}"), (3, f"Third {line}\n{stub}\n\n{table}\n\nEnd."), (4, f"  {line.upper()}")]
    want = {1: rows[0][1], 2: f"{stub}\nSecond own text.\n", 3: f"Third {line}\nEnd.", 4: "  "}
    assert unit_dedup.brute_dedup(rows) == want
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.text for r in unit_dedup.dedup(frame).collect()} == want


def test_odd_rows(spark, odd_docs, no_docs):
    got = {(r.doc_id, r.text, r.changed) for r in unit_dedup.dedup(odd_docs, 5).collect()}
    assert (1, "", False) in got and (7, "", True) in got and (6, "Same text here for two rows, the very same text.", False) in got
    assert unit_dedup.dedup(no_docs).count() == 0


def test_query(spark):
    from graphspark.llm.queries import op8_unit_dedup

    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert {r.doc_id: r.text for r in op8_unit_dedup(spark, folder).collect()} == unit_dedup.brute_dedup(rows)
