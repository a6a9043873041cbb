import base64
import random

import pytest

from kelpwright.llm.bpe import count_tokens, default_vocabulary, encode_corpus

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers

    with open(default_vocabulary(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    None, "", " ", "   ", "\n", " \n ", "a", " a", "a ", "a  b", "a\t b", "it's we'll 'tis they'd've ''s !'s \n'll 'LL '", "x's", "1'st 2'd", "'",
    "<|endoftext|>", "don’t", "漢字かな交じり文 テスト", "Ωμέγα", "🙂🙂👍🏽", "é é", "a b c　d", "\x00\x1c\x1d\x85x", "0123456789 12,345.67",
    "-" * 999, "aaaaaaaaaaaaaaaaaaaaaa", "=" * 64 + " " * 65, "\r\n\r\n  indented", "{\"k\": [1, 2.5e-3, null]}", "word" * 5000, "ﷺ़़", "﻿bom", "x'",
]


def test_equals_a_reference_encoder(spark, reference):
    rng = random.Random(1)
    alphabet = "abcdefgst'' \n\t1234é漢🙂.,-_=<|> "
    texts = [*TEXTS, *("".join(rng.choices(alphabet, k=rng.randint(0, 80))) for _ in range(2000)), "x'", "'s", None]
    df = spark.createDataFrame([(k, t, "z") for k, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in encode_corpus(df).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        assert got[k] == reference.encode_ordinary(t or ""), repr(t)
    sizes = {r.doc_id: r.n_tokens for r in count_tokens(df).collect()}
    assert sizes == {k: len(v) for k, v in got.items()}


def test_round_trip_repeats_null_ids_and_empty_table(spark, reference):
    df = spark.createDataFrame([(None, "same"), (1, "same"), (1, "same")], "doc_id long, text string")
    rows = encode_corpus(df).collect()
    assert len(rows) == 3 and all(reference.decode(r.ids) == "same" for r in rows)
    assert encode_corpus(df.limit(0)).collect() == []


def test_output_name_must_not_clash(spark):
    df = spark.createDataFrame([(1, "a")], "ids long, text string")
    with pytest.raises(ValueError):
        encode_corpus(df, keep=("ids",))
