import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import evaluation as E
from corvane.operators.positions import positions, quantiles


def test_agreeing_pairs():
    r = random.Random(1)
    for m in (0, 1, 2, 7, 40):
        for _ in range(20):
            pts = {(r.randrange(6), r.randrange(6)): r.randrange(1, 4) for _ in range(m)}
            x, y, n = (np.array(v, np.int64) for v in zip(*((a, b, c) for (a, b), c in pts.items()), strict=True)) if pts else (np.zeros(0, np.int64),) * 3
            want = sum(p[2] * q[2] * ((p[0] > q[0]) - (p[0] < q[0])) * ((p[1] > q[1]) - (p[1] < q[1])) for p, q in itertools.combinations([(a, b, c) for (a, b), c in pts.items()], 2))
            assert E._agreeing(x, y, n) == want


@pytest.mark.parametrize("bucket", [3, 4096])
def test_tau_on_true_ranks(spark, bucket):
    r = random.Random(2)
    rows = [("hot", f"i{k}", k + 1, 1 + r.randrange(90)) for k in range(150)] + [("few", "a", 1, 2), ("few", "b", 2, 1), ("one", "a", 1, 1), ("null", "a", None, 1)]
    df = spark.createDataFrame(rows, "g string, i string, m int, j int").withColumn("n", F.lit("clash"))
    got = {x.g: (x.n, x.tau) for x in E.kendall_tau_b(df, "g", "i", "m", "j", bucket).collect()}
    hot = [(m, j) for g, _, m, j in rows if g == "hot"]
    sign = lambda a, b: (a > b) - (a < b)
    pairs = list(itertools.combinations(hot, 2))
    d = sum(sign(a[0], b[0]) * sign(a[1], b[1]) for a, b in pairs)
    root = math.sqrt(sum(a[0] != b[0] for a, b in pairs) * sum(a[1] != b[1] for a, b in pairs))
    assert got["hot"] == (150, pytest.approx(d / root)) and got["few"] == (2, -1.0) and got["one"] == (1, None) and "null" not in got
    assert E.kendall_tau_b(df.limit(0), "g", "i", "m", "j").count() == 0


def test_positions_of_a_group_over_partitions(spark):
    r = random.Random(3)
    rows = [("hot", r.randrange(50), i) for i in range(4000)] + [(f"g{i % 40}", i, i) for i in range(200)] + [(None, i, i) for i in range(30)]
    df = spark.createDataFrame(rows, "g string, s int, id int")
    got = positions(df, "g", [F.desc("s"), F.col("id")]).collect()
    want = {}
    for g, s, i in sorted(rows, key=lambda x: (str(x[0]), -x[1], x[2])):
        want.setdefault(g, []).append(i)
    assert len(got) == len(rows) and all(want[x.g][x.position - 1] == x.id for x in got)
    assert positions(df.limit(0), "g", [F.col("s")]).count() == 0
    q = {x.g: (x.a, x.b) for x in quantiles(df, "g", "s", {"a": 0.5, "b": 0.9}).collect()}
    hot = np.array([s for g, s, _ in rows if g == "hot"])
    assert q["hot"] == pytest.approx((np.quantile(hot, 0.5), np.quantile(hot, 0.9))) and q[None] == pytest.approx((14.5, 26.1))


def test_ranking_report_and_suppression(spark):
    rows = [(f"g{k}", f"i{i}", i + 1, i + 1, lang) for k, (n, lang) in enumerate([(5, "en"), (5, "id"), (2, "fr"), (1, "en")]) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i string, m int, j int, lang string")
    got = {(x.field, x.value): x for x in E.ranking_report(df, "g", "i", "m", "j", ["lang"]).collect()}
    assert got[None, None].groups == 3 and got[None, None].tau == 1.0 and got[None, None].items == 12
    assert {v for f, v in got if f and got[f, v].reported} == {"en"} and got["lang", "fr"].tau is None


def test_agreement_and_model_reports(spark):
    rows = [("supported", "supported", f"c{i}") for i in range(5)] + [("partial", "supported", "c1")]
    df = spark.createDataFrame(rows, "a string, p string, c string")
    assert not E.agreement_metrics(df, "a", "p", "c").first().reported
    same = E.agreement_metrics(df.limit(5), "a", "p", "c").first()
    assert (same.exact, same.rate, same.kappa) == (5, 1.0, None)
    m = {x.label: x for x in E.model_report(df.limit(5), "a", "p", "c", ["supported", "partial"]).collect()}
    assert m["supported"].support == 5 and m["supported"].accuracy == 1.0 and m["partial"].support == 0
    hidden = {x.label: x for x in E.model_report(df, "a", "p", "c", ["supported", "partial"]).collect()}
    assert not hidden["partial"].reported and not hidden["supported"].reported and hidden["supported"].accuracy is None


def test_token_errors_of_any_length(spark):
    long = [f"w{i}" for i in range(7000)]
    df = spark.createDataFrame([(long, long[:-1]), (["a"], None), ([], ["q"]), ("a b c".split(), "x a c".split())], "r array<string>, h array<string>")
    assert [(x.e.edits, x.e.words) for x in df.select(E.token_error(F.col("r"), F.col("h")).alias("e")).collect()] == [(1, 7000), (None, None), (1, 0), (2, 3)]
    t = spark.createDataFrame([("Ｃ++ and Node.js, ﬁne_x",), (None,)], "t string").select(E.error_tokens("t").alias("w")).collect()
    assert [x.w for x in t] == [["c++", "and", "node.js", "fine", "x"], []]
    rows = spark.createDataFrame([("v", 1, 10), ("v", 1, 10), ("w", None, 10), ("w", 1, 10)], "v string, edits int, words int")
    got = {x.v: (x.state, x.words, x.edits, x.error_rate) for x in E.corpus_error(rows, ["v"]).collect()}
    assert got == {"v": ("complete", 20, 2, 0.1), "w": ("partial", None, None, None)}


def test_offline_measures(spark):
    e = spark.createDataFrame([("c", "k1", "matched", "Built APIs", 0), ("c", "k2", "partial", "other words here", None), ("c", "k3", "matched", "absent", 1), ("c", "k4", "unknown", "x", 1), ("z", "k1", "matched", "", None)], "candidate_id string, criterion_id string, result string, snippet string, line_no int")
    lines = spark.createDataFrame([("c", 0, "Built  APIs in Go"), ("c", 1, "Some other line")], "candidate_id string, line_no int, line string")
    got = {(x.candidate_id, x.criterion_id): (x.verbatim, x.attributed) for x in E.groundedness(e, lines).collect()}
    assert got == {("c", "k1"): (True, True), ("c", "k2"): (False, True), ("c", "k3"): (False, False), ("z", "k1"): (False, False)}
    t = spark.createDataFrame([(float(i), None if i else 1.0) for i in range(101)], "a double, b double")
    s = {x.measure: (x.n, x.median, x.p95, x.max) for x in E.latency_summary(t, ["a", "b"]).collect()}
    assert s == {"a": (101, 50.0, 95.0, 100.0), "b": (1, 1.0, 1.0, 1.0)}
    r = E.relevance_labels(spark.createDataFrame([("x",), ("y",), (None,)], "c string"), "c", ["x"], ["y"]).collect()
    assert [v.rel for v in r] == [2, 1, 0]
    docs = spark.createDataFrame([("d", "Python here")], "doc_id string, text string")
    heads = spark.createDataFrame([("v1", "Name: A"), ("v2", "Python")], "variant string, header string")
    assert sorted(x.text for x in E.inject_headers(docs, heads).collect()) == ["Name: A\nPython here", "Python\nPython here"]
