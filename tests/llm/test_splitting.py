import random

import pytest

from corvane.llm.bpe import bpe, vocabulary_path
from corvane.llm.splitting import split_oversized, split_text
from corvane.session import table

PATH = vocabulary_path("byte_bpe_50k.tiktoken")


def check(text, limit, overlap):
    b = bpe(PATH)
    pieces = split_text(text, limit, overlap, b)
    assert "".join(text[s:e] for _, s, e, *_ in pieces) == text
    for begin, start, end, shared, size, _ in pieces:
        assert size == len(b.encode(text[begin:end])) <= limit
        assert shared == len(b.encode(text[begin:start])) <= overlap or shared <= overlap + 1
    return pieces


@pytest.mark.parametrize(("limit", "overlap"), [(20, 0), (20, 5), (64, 16), (5, 4)])
def test_properties(limit, overlap):
    r = random.Random(limit)
    for _ in range(60):
        parts = [r.choice(["word", "Two words.", "end!", "x" * r.randrange(80), "日本語" * r.randrange(9), "\n", "\n\n", " ", "\r\n", "a,b;c", "😀"]) + r.choice([" ", "", "  "]) for _ in range(r.randrange(80))]
        check("".join(parts), limit, overlap)


def test_long_run():
    r = random.Random(9)
    assert len(check("".join(r.choice("abcdefg") for _ in range(20_000)), 100, 20)) > 60


def test_natural_boundaries():
    text = "\n\n".join(" ".join(["One sentence stands here alone."] * 4) for _ in range(6))
    pieces = check(text, 60, 0)
    assert {p[5] for p in pieces} == {5}
    sent = " ".join(["One sentence stands here alone."] * 40)
    assert {p[5] for p in check(sent, 60, 8)[1:]} == {3}
    shared = [p[3] for p in check(sent, 60, 8)[1:]]
    assert min(shared) == 8 or min(shared) >= 6


def test_columns(spark):
    df = spark.createDataFrame([(1, "a b c " * 100, 1), (2, "", 2), (3, None, 3), (4, "short", 4)], "doc_id bigint, text string, piece int")
    out = split_oversized(df, 50, 10).collect()
    by = {k: sorted([x for x in out if x.doc_id == k], key=lambda x: x.piece) for k in (1, 2, 3, 4)}
    assert len(by[1]) > 5 and [x.text for x in by[2]] == [""] and by[3] == [] and [(x.text, x.n_tokens, x.cut) for x in by[4]] == [("short", 1, "start")]
    assert split_oversized(df.limit(0), 50, 10).count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, 10, 10)


def test_corpus(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    b = bpe(PATH)
    joined = {}
    for x in sorted(split_oversized(docs, 256, 32).collect(), key=lambda x: (x.doc_id, x.piece)):
        assert x.n_tokens == len(b.encode(x.text)) <= 256
        joined[x.doc_id] = joined.get(x.doc_id, "") + texts[x.doc_id][x.start : x.end]
    assert joined == {k: t for k, t in texts.items() if t is not None}


def test_overlap_reaches_into_long_words():
    r = random.Random(11)
    for limit, overlap in ((64, 8), (40, 10)):
        word = lambda: "".join(r.choice("abcdefghij-_/.") for _ in range(r.randrange(30, 60)))
        pieces = check(" ".join(word() for _ in range(60)), limit, overlap)
        assert all(0 < p[3] <= overlap + 1 for p in pieces[1:])
        assert sum(p[3] for p in pieces[1:]) / len(pieces[1:]) > 0.6 * overlap
