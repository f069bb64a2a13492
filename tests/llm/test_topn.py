import math
import random

import pytest

from corvane.llm.topn import top_n

S = "g string, s double, t int, i string, position string"


def brute(rows, n):
    groups = {}
    for g, s, t, i, _ in rows:
        if g is not None and s is not None and not math.isnan(s):
            groups.setdefault(g, set()).add((-s, t is None, t or 0, i is None, i or ""))
    return {(g, k[4] if not k[3] else None, p) for g, v in groups.items() for p, k in enumerate(sorted(v)[:n], 1)}


@pytest.mark.parametrize("n", [1, 5, 40])
def test_against_brute_force(spark, n):
    r = random.Random(n)
    rows = []
    for _ in range(4000):
        g = r.choice(["hot"] * 5 + [f"g{r.randrange(300)}", None])
        rows.append((g, r.choice([None, float("nan"), 0.0, -0.0, 1.5, r.randrange(20) / 2]), r.choice([None, 1, 2, r.randrange(50)]), r.choice([None, f"i{r.randrange(3000):04}"]), "x"))
    rows += rows[:300]
    df = spark.createDataFrame(rows, S).repartition(5)
    got = top_n(df, "g", "s", "t", "i", n, partitions=16).collect()
    assert {(x.g, x.i, x.position) for x in got} == brute(rows, n)
    assert len(got) == len(brute(rows, n))


def test_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(f"g{k % 3}", float(k % 11), k % 4, f"i{k % 60}", "") for k in range(300)]
        got = top_n(spark.createDataFrame(rows, S), "g", "s", "t", "i", 9, partitions=4).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(x.g, x.i, x.position) for x in got} == brute(rows, 9)


def test_empty(spark):
    assert top_n(spark.createDataFrame([], S), "g", "s", "t", "i", 3).count() == 0
