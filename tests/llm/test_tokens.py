from __future__ import annotations

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from graphspark.llm.tokens import Counter, count_tokens, load_byte_bpe, merged_length

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_merges_lowest_rank_first_then_leftmost():
    ranks = {("b", "c"): 0, ("a", "b"): 1, ("a", "bc"): 2}
    assert merged_length(list("abc"), ranks) == 1
    assert merged_length(list("ab"), ranks) == 1
    assert merged_length(list("aaa"), {("a", "a"): 0}) == 2
    assert merged_length([], ranks) == 0


def test_counts_as_the_library_does(library):
    count = Counter(*load_byte_bpe(PATH))
    r = random.Random(0)
    alphabet = "ab zé\n\t'sllve 　\x1c\x851२½你😀́#.  "
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(3000)] + ["x<|endoftext|>y <|endoftext|>", "", "a" * 3000, " " * 200, "it's we'll I'd"]
    assert [count(t) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_rows(spark, odd_docs, no_docs, library):
    got = count_tokens(odd_docs, PATH, limit=512).collect()
    assert len(got) == 10
    by = {r.doc_id: r for r in got}
    assert (by[1].n_bytes, by[1].n_tokens, by[1].over_limit) == (0, 0, False)
    assert by[5].over_limit and by[5].n_tokens == len(library.encode("word " * 30_000, add_special_tokens=False).ids)
    assert count_tokens(no_docs, PATH).count() == 0


def test_whole_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in count_tokens(docs, PATH).collect()} == want
