import random

import pytest
from tokenizers import Tokenizer

from corvane.llm.bpe import ByteBPE, count_array, token_counts, token_ids, vocabulary_path
from corvane.session import table

CASES = ["", " ", "a", "  a  b ", "a \nb", "a\n \n b", "\t x", "x \t y", "don't we'll I'M", "<|endoftext|> a", "naïve café 😀👩‍💻", "½ ² Ⅷ 12 500", "a b　c d", "\r\n\r\n  x", "x " * 50 + "  ", "日本語 テキスト", "\x1c \x85 a", "_a_ __", "é ́", "a  ", "a   b", " \n", "a\x1c b", "!\x1c !", "a\n b\n c\n", "\x1d \x1d", "\n ", "a\t b", "​ ﻿ x"]


@pytest.fixture(scope="module")
def own():
    return ByteBPE(vocabulary_path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def public():
    t = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_cases(own, public):
    for s in CASES:
        assert own.encode(s) == public(s), repr(s)
        assert own.decode(own.encode(s)) == s


def test_both_files_agree(own):
    ranks = ByteBPE(vocabulary_path("byte_bpe_50k.json")).ranks
    assert {s: i for s, i in ranks.items() if i < 50256} == own.ranks


def test_random(own, public):
    r = random.Random(3)
    alphabet = "aabcdeest  \n\t.,'12éß日😀_- ́½"
    for _ in range(1500):
        s = "".join(r.choice(alphabet) for _ in range(r.randrange(40)))
        assert own.encode(s) == public(s), repr(s)


def test_long_run(own, public):
    r = random.Random(4)
    s = "".join(r.choice("abcdef") for _ in range(60_000))
    assert own.encode(s) == public(s)
    assert len(own.encode("a" * 200_000)) == len(public("a" * 200_000))


def test_columns(spark, own):
    df = spark.createDataFrame([(1, "two words", 7), (2, "", 8), (3, None, 9), (3, None, 9)], "doc_id bigint, text string, ids int")
    got = {(r.doc_id, tuple(r.ids)) for r in token_ids(df).collect()}
    assert got == {(1, tuple(own.encode("two words"))), (2, ()), (3, ())}
    assert token_ids(df).count() == 4 and token_ids(df.limit(0)).count() == 0
    assert sorted((r.doc_id, r.n_tokens) for r in token_counts(df).collect()) == [(1, 2), (2, 0), (3, 0), (3, 0)]


def test_pool_resets(own, monkeypatch):
    import pyarrow as pa

    from corvane.llm import bpe as module

    monkeypatch.setattr(module, "MEMO", 5)
    path = vocabulary_path("byte_bpe_50k.tiktoken")
    for k in range(4):
        texts = pa.array([f"one{k} two{i} three" for i in range(9)] + [None, ""])
        assert module.encode_array(texts, path).to_pylist() == [own.encode(t) if t else [] for t in texts.to_pylist()]
        assert count_array(texts, path).tolist() == [len(own.encode(t)) if t else 0 for t in texts.to_pylist()]


def test_corpus(spark, public):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in token_ids(docs).collect():
        assert r.ids == public(texts[r.doc_id] or "")
