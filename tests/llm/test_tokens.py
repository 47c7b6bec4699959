import base64
import random

import pytest

from loomgraph.llm import tokens

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(tokens.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    None, "", " ", "\t\n  x", "Hello, world! It's 2024's <|endoftext|> day", "naïve Ünïcödé 你好，世界 мир 👩‍🔧🏽 ١٢٣", "a\r\n\r\r\nb", "\x00\x07", "hello",
    "x" * 3000, "ab" * 2000, "=" * 5001, "漢字" * 400, " " * 999, "https://www.heron.test/p/1?q=%20&x=[1,2]",
]


def test_texts_of_all_kinds(spark, reference):
    rnd = random.Random(6)
    extra = ["".join(rnd.choice("abcdefgh 1.é漢\n") for _ in range(rnd.randrange(1500))) for _ in range(40)]
    rows = [(i, t, [1]) for i, t in enumerate(TEXTS + extra)] + [(0, None, [1]), (4, TEXTS[4], [1])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>")
    got = tokens.encode_texts(df).collect()
    assert len(got) == len(rows)
    texts = dict((i, t) for i, t, _ in rows)
    for r in got:
        t = texts[r["doc_id"]]
        assert r["ids"] == (reference.encode_ordinary(t) if t else []), t
    counts = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(df).collect()}
    assert counts == {r["doc_id"]: len(r["ids"]) for r in got}


def test_forgetting_and_blocks(spark, reference, monkeypatch):
    encoder = tokens.Encoder(tokens.VOCABULARY)
    first = encoder.encode(["one two three", None]).to_pylist()
    encoder.forget()
    assert encoder.encode(["one two three", None]).to_pylist() == first == [reference.encode_ordinary("one two three"), []]


def test_empty_table(spark):
    assert tokens.encode_texts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_decoding_gives_the_texts_back(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in tokens.decode_ids(tokens.encode_texts(df)).collect()}
    assert got == {i: t or "" for i, t in enumerate(TEXTS)}
    rows = spark.createDataFrame([(1, None, 2), (2, [], 3), (3, [158, 120], 4)], "doc_id long, ids array<int>, text int")
    assert [r["text"] for r in tokens.decode_ids(rows).orderBy("doc_id").collect()] == [None, "", "\ufffd"]


def test_both_ways_of_contracting_words_agree(monkeypatch, reference):
    words = ["ab" * 90, "x" * 200, "漢字" * 40, "abcabd" * 30]
    short = tokens.Encoder(tokens.VOCABULARY).encode(words).to_pylist()
    monkeypatch.setattr(tokens, "LONG_WORD", 8)
    assert tokens.Encoder(tokens.VOCABULARY).encode(words).to_pylist() == short == [reference.encode_ordinary(w) for w in words]
