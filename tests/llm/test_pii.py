from __future__ import annotations

import random
import re

import duckdb
import numpy as np
import pytest

from graphspark.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for kind in pii.KINDS:
        for m in re.finditer(PATTERNS[kind], text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((*m.span(), kind))
    return out


@pytest.fixture(scope="module")
def tagger():
    """Trained as the operator does, on prose of documents that the tests below don't use."""
    rows = duckdb.sql("SELECT text FROM '/root/testdata/sf0.1/documents.parquet' WHERE length(text) > 200 ORDER BY doc_id DESC LIMIT 2000").fetchall()
    r = random.Random(5)
    return pii.trained_tagger(carriers=tuple(t[(a := r.randint(0, max(0, len(t) - 200))) : a + 200] for (t,) in rows))


def test_base_spans_are_those_of_the_patterns():
    r = random.Random(1)
    for _ in range(20_000):
        text = "".join(r.choice("12 0.-@+()ab.1-@9") for _ in range(r.randint(0, 50)))
        assert pii.base_spans(text) == brute(text)


def test_gradient():
    t = pii.Tagger(dim=3, hidden=4)
    codes, tags = pii.labelled_windows(2, seed=3)
    codes, tags = codes[:, :20], np.zeros((2, 20), np.int64)
    tags[0, 5:9] = [1, 2, 2, 2]
    for key in t.p:
        t.p[key] = t.p[key].astype(np.float64)
    _, grad = t.loss_and_grad(codes, tags)
    for key in ("V", "Wf", "Wb", "T"):
        at = (1, 2)
        keep, h = t.p[key][at], 1e-3
        t.p[key][at] = keep + h
        up = t.loss_and_grad(codes, tags)[0]
        t.p[key][at] = keep - h
        down = t.loss_and_grad(codes, tags)[0]
        t.p[key][at] = keep
        assert abs((up - down) / (2 * h) - grad[key][at]) < 5e-3


def test_pruning_is_exact(tagger):
    codes, _ = pii.labelled_windows(200, seed=98)
    lengths = np.random.default_rng(0).integers(20, codes.shape[1] + 1, len(codes))
    slow, _ = tagger.emissions(codes)
    _, trans, start = tagger.tables()
    want = pii._viterbi(np.ascontiguousarray(slow.transpose(1, 2, 0)), lengths, trans, start[:, None])
    got = tagger.decode(codes, lengths)
    assert [[x[:3] for x in w] for w in got] == [[x[:3] for x in w] for w in want] and sum(map(len, got)) > 50


def test_emissions_are_those_of_the_plain_network(tagger):
    codes, _ = pii.labelled_windows(50, seed=97)
    assert np.abs(tagger.fast_emissions(codes) - tagger.emissions(codes)[0].transpose(1, 2, 0)).max() < 1e-3


def test_held_out_documents(tagger):
    """Spans in notations that the patterns don't know, put into documents that training never saw."""
    rows = duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE length(text) > 200 ORDER BY doc_id LIMIT 250").fetchall()
    r, texts, truth = random.Random(99), [], []
    for (text,) in rows:
        text = text[:4000]  # the documents of this test, not of the operator
        old = pii.shapes(text)
        cuts = sorted(r.sample([i for i, c in enumerate(text) if c == " " and not any(a <= i < b for a, b, _ in old)], 4))
        out, marks, at = "", [], 0
        for c in cuts:
            out, at = out + text[at:c] + " ", c
            if r.random() < 0.6:
                kind, s = pii._entity(r)
                marks.append((len(out), len(out) + len(s), kind))
                out += s
            else:
                out += pii._decoy(r)
        texts.append(out + text[at:])
        truth.append(marks)
    hit, miss, extra = ({k: 0 for k in pii.KINDS} for _ in range(3))
    for marks, (base, added) in zip(truth, pii.all_spans(texts, tagger)):
        want = {m for m in marks if not any(a < m[1] and m[0] < b for a, b, _ in base)}
        for found, count in ((want & set(added), hit), (want - set(added), miss), (set(added) - want, extra)):
            for m in found:
                count[m[2]] += 1
    for k in pii.KINDS:
        assert hit[k] >= 30 and hit[k] / (hit[k] + miss[k]) >= 0.9 and hit[k] / (hit[k] + extra[k]) >= 0.9, (k, hit, miss, extra)
    clean = pii.all_spans([t for (t,) in rows], tagger)
    assert sum(len(added) for _, added in clean) <= 0.005 * len(rows)


def test_model_adds_spans_and_leaves_clean_text_alone(tagger):
    added = lambda t: [(t[a:b], k) for a, b, k in pii.all_spans([t], tagger)[0][1]]
    assert ("(415) 555-1234", "phone") in added("the and call (415) 555-1234 now and the")
    assert added("the tion of 2024-11-26 10:22:33 and 12,345 in 7.") == []
    assert added("nothing here at all") == []
    far = "the and " * 400 + "call (415) 555-1234 now" + " the and" * 400
    assert [k for _, k in added(far)] == ["phone"]


def test_spans_at_the_edges_of_windows(tagger):
    span = "(415) 555-1234"
    for place in range(pii.STEP - 20, pii.WIDTH + 8):
        text = ("the and of " * 60)[:place] + " " + span + " the tion of" * 30
        (_, added), = pii.all_spans([text], tagger)
        assert [text[a:b] for a, b, k in added if k == "phone"] == [span], place


def test_reconciling():
    assert pii.heaviest([(0, 5, "ip", 1.0), (3, 9, "phone", 1.0), (9, 12, "ip", 1.0)]) == [(3, 9, "phone", 1.0), (9, 12, "ip", 1.0)]
    assert pii.redact("a b@c.de f", [(2, 8, "email")]) == "a <email> f"


def test_rows(spark, odd_docs, no_docs):
    got = pii.find_pii(odd_docs, windows=200).collect()
    assert len(got) == 10
    by = {r.doc_id: [(s.kind, s.start, s.end, s.added) for s in r.spans] for r in got}
    assert by[1] == [] and by[8] == [("email", 11, 20, False), ("phone", 24, 41, False)]
    assert pii.find_pii(no_docs, windows=200).count() == 0


def test_query(spark):
    from graphspark.llm.queries import op2_pii_spans

    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in op2_pii_spans(spark, "/root/testdata/sf0.001").collect():
        base = brute(docs[r.doc_id])
        assert r.base_sha256 == pii.sha256_hex(",".join(f"{k}:{a}:{b}" for a, b, k in base))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[2] == k for x in base) for k in pii.KINDS)
