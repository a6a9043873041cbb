import random

import numpy as np
import pytest

from kelpwright.llm.spans import chunk_spans, cut_window, shared_spans


def brute(docs, span):
    where = {}
    for d, t in docs:
        for k in range(len(t or "") - span + 1):
            where.setdefault(t[k : k + span], set()).add(d)
    out = {}
    for d, t in dict(docs).items():
        own = np.zeros(len(t or ""), bool)
        for k in range(len(t or "") - span + 1):
            if where[t[k : k + span]] - {d}:
                own[k : k + span] = True
        if own.any():
            out[d] = int(own.sum())
    return out


def corpus(seed):
    rng = random.Random(seed)
    letters = "abcdefghij klmnop\nqrstuvé漢🙂"
    text = lambda n: "".join(rng.choices(letters, k=n))
    pool = [text(rng.choice([148, 149, 150, 151, 170, 260, 700])) for _ in range(25)] + ["=" * 400, "ab" * 200]
    docs = [(k, "".join(rng.choice([text(rng.randint(0, 200)), rng.choice(pool), rng.choice(pool)[rng.randint(0, 40) :]]) for _ in range(rng.randint(0, 6)))) for k in range(120)]
    return docs + [(500, None), (501, ""), (502, "x" * 149), (503, "x" * 150), (504, "x" * 5000), (505, docs[3][1]), (506, text(40_000) + pool[0] * 3)]


@pytest.mark.parametrize("crowd", [20_000, 1])
def test_against_brute_force(spark, crowd):
    docs = corpus(crowd)
    rows = [(d, t, 9) for d, t in docs] + [(d, t, 9) for d, t in docs[:30]] + [(None, docs[5][1], 1)]
    got = shared_spans(spark.createDataFrame(rows, "doc_id long, text string, shared_chars int"), crowd=crowd)
    assert got.columns == ["doc_id", "shared_chars"]
    assert {r.doc_id: r.shared_chars for r in got.collect()} == brute(docs, 150)


def test_a_chunk_repeated_in_one_record_and_one_in_many(spark):
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    unit, notice, own = ("".join(rng.choices(letters, k=n)) for n in (300, 400, 10))
    docs = [(0, unit * 2000), (1, "x" + unit)] + [(k, f"{k} {own} {notice}") for k in range(2, 400)]
    got = {r.doc_id: r.shared_chars for r in shared_spans(spark.createDataFrame(docs, "doc_id long, text string"), crowd=100).collect()}
    assert got[0] == 300 * 2000 - 0 and got[1] == 300
    assert all(len(notice) <= got[k] <= len(notice) + 14 for k in range(2, 400)) and len(got) == 400


def test_empty(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert shared_spans(df).collect() == [] and shared_spans(df.limit(0)).collect() == []


def test_every_long_enough_passage_has_a_whole_chunk():
    width = cut_window(150)
    rng = np.random.default_rng(2)
    for _ in range(50):
        passage = rng.integers(97, 97 + int(rng.integers(1, 26)) + 1, 150).astype(np.uint32)
        found = []
        for lead in (0, 7, 400):
            cps = np.concatenate([rng.integers(97, 123, lead).astype(np.uint32), passage, rng.integers(97, 123, 90).astype(np.uint32)])
            start, end, _, _ = chunk_spans(cps, np.array([0, len(cps)]), width)
            found.append({(s - lead, e - lead) for s, e in zip(start, end, strict=True) if s >= lead and e <= lead + 150})
        assert found[0] & found[1] & found[2]
