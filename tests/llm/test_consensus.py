import math
import random

import pytest
from pyspark.sql import functions as F

from corvane.llm.consensus import clean_label, consensus, digamma, krippendorff_alpha

L = ["a", "b", "c"]


def test_digamma(spark):
    x = [0.01, 0.5, 1.0, 3.7, 250.0]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    got = [r.d for r in df.select(digamma(F.col("x")).alias("d")).collect()]
    for v, d in zip(x, got, strict=True):
        h = 1e-5 * max(v, 0.1)
        assert d == pytest.approx((math.lgamma(v + h) - math.lgamma(v - h)) / (2 * h), rel=1e-5)


def test_labels(spark):
    df = spark.createDataFrame([(" No-Evidence",), ("no  evidence\t",), ("NO_EVIDENCE",), ("n/a",), ("",), (None,)], "t string")
    got = [r.l for r in df.select(clean_label(F.col("t"), ["no_evidence"]).alias("l")).collect()]
    assert got == ["no_evidence"] * 3 + [None] * 3


def test_recovers_truth_and_reliability(spark):
    r = random.Random(1)
    right = {f"r{k}": p for k, p in enumerate([0.95, 0.9, 0.85, 0.6, 0.5, 0.34])}
    truth, votes = {}, []
    for i in range(900):
        truth[f"i{i}"] = t = r.choices(L, [5, 3, 2])[0]
        for a in r.sample(sorted(right), 4):
            votes.append((f"i{i}", a, t if r.random() < right[a] else r.choice([x for x in L if x != t]), "x"))
    votes += votes[:50]
    df = spark.createDataFrame(votes, "item string, annotator string, label string, n0 string")
    out = consensus(df, L)
    got = {x.item: x for x in out.items.collect()}
    accuracy = sum(got[i].label == t for i, t in truth.items()) / len(truth)
    majority = 0
    for i, t in truth.items():
        mine = [x[2] for x in votes if x[0] == i]
        majority += max(L, key=mine.count) == t
    assert accuracy > 0.87 and accuracy > majority / len(truth)
    assert all(abs(sum(x[f"p_{c}"] for c in L) - 1) < 1e-9 for x in got.values())
    people = {x.annotator: x for x in out.annotators.collect()}
    for a, p in right.items():
        assert abs(people[a].reliability - p) < 0.08 and people[a].low < people[a].reliability < people[a].high


def test_odd_votes_and_items(spark):
    S = "item string, annotator string, label string"
    votes = spark.createDataFrame([("i", "x", "a"), ("i", "x", "a"), (None, "x", "a"), ("j", None, "b"), ("j", "y", "zzz"), ("j", "y", None)], S)
    items = spark.createDataFrame([("i",), ("i",), ("j",), (None,)], "item string")
    got = {x.item: (x.label, x.n_votes) for x in consensus(votes, L, items=items).items.collect()}
    assert got == {"i": ("a", 1), "j": ("a", 0)}
    none = consensus(votes.limit(0), L, items=items)
    assert {x.item: round(x.probability, 6) for x in none.items.collect()} == {"i": 0.333333, "j": 0.333333}
    assert none.annotators.count() == 0


def test_alpha(spark):
    # Krippendorff's published nominal example with missing values
    data = {"A": "1 2 3 3 2 1 4 1 2 . . .", "B": "1 2 3 3 2 2 4 1 2 5 . 3", "C": ". 3 3 3 2 3 4 2 2 5 1 .", "D": "1 2 3 3 2 4 4 1 2 5 1 ."}
    rows = [(u, c) for line in data.values() for u, c in enumerate(line.split()) if c != "."]
    df = spark.createDataFrame(rows, "u int, label string")
    got = krippendorff_alpha(df, ["u"]).first()
    assert got.alpha == pytest.approx(0.743, abs=5e-4) and got.n_items == 11 and got.n_votes == 40
    assert krippendorff_alpha(df.limit(0), ["u"]).first().alpha is None


def test_both_ways_agree(spark):
    r = random.Random(2)
    votes = [(f"i{i}", f"r{r.randrange(9)}", r.choice(L)) for i in range(200) for _ in range(4)]
    df = spark.createDataFrame(votes, "item string, annotator string, label string")
    items = spark.createDataFrame([(f"i{i}",) for i in range(205)], "item string")
    shared, joined = consensus(df, L, items=items, rounds=4), consensus(df, L, items=items, rounds=4, pairs=3)
    a, b = ({x.item: x for x in c.items.collect()} for c in (shared, joined))
    assert len(a) == 205 and a.keys() == b.keys()
    assert all(a[i].label == b[i].label and a[i].n_votes == b[i].n_votes and abs(a[i].probability - b[i].probability) < 1e-9 for i in a)
    p, q = ({x.annotator: x for x in c.annotators.collect()} for c in (shared, joined))
    assert p.keys() == q.keys() and all(abs(p[x].reliability - q[x].reliability) < 1e-9 for x in p)
    assert not shared.converged and shared.rounds == joined.rounds == 4
