import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm.packing import fill_report, first_fit_decreasing, pack


def brute(sizes, cap):
    free, out = [], []
    for s in sizes:
        for k, f in enumerate(free):
            if f >= s:
                break
        else:
            k = len(free)
            free.append(cap)
        free[k] -= s
        out.append(k)
    return out


def test_first_fit():
    r = random.Random(1)
    for _ in range(200):
        cap = r.randrange(1, 50)
        sizes = sorted((r.randrange(cap + 1) for _ in range(r.randrange(60))), reverse=True)
        assert first_fit_decreasing(np.array(sizes, np.int64), cap).tolist() == brute(sizes, cap)


@pytest.mark.parametrize("group", [20_000, 300])
def test_pack(spark, group):
    r = random.Random(2)
    rows = [(k, r.choice([None, 0, 1, 500, 512, 513, 5000, r.randrange(600)])) for k in range(2000)] + [(7, 100)] * 600
    out = pack(spark.createDataFrame(rows, "doc_id bigint, n_tokens int").withColumn("part", F.lit("clash")), 512, group_items=group).collect()
    used = {}
    parts = {}
    for x in out:
        used[x.container] = used.get(x.container, 0) + x.n_tokens
        parts.setdefault(x.doc_id, []).append((x.from_token, x.n_tokens))
    assert max(used.values()) <= 512
    assert sum(used.values()) == sum(s or 0 for _, s in rows)
    assert {x.doc_id for x in out} == {k for k, _ in rows}
    size = dict(rows[:2000])
    for k, p in parts.items():
        if k != 7:
            assert len(p) == max(1, -(-(size[k] or 0) // 512))
            assert all(n == 512 for _, n in sorted(p)[:-1])
    assert sum(used.values()) / (len(used) * 512) > 0.95


def test_report_and_empty(spark):
    e = pack(spark.createDataFrame([], "doc_id bigint, n_tokens int"), 512)
    assert e.count() == 0
    r = fill_report(pack(spark.createDataFrame([(1, 300), (2, 200), (3, 100)], "doc_id bigint, n_tokens int"), 300), 300).first()
    assert (r.containers, r.tokens, r.least_containers) == (2, 600, 2)
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([], "doc_id bigint, n_tokens int"), 0)


def test_file_order_makes_no_difference(spark):
    r = random.Random(4)
    rows = [(k, r.randrange(1, 600)) for k in range(1500)] + [(3, 40)] * 50 + [(None, 7)] * 3
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens int")
    a, b = ([tuple(x) for x in pack(x, 512, group_items=200).collect()] for x in (df.repartition(1), df.repartition(7)))
    assert sorted(a, key=str) == sorted(b, key=str) and len(a) >= len(rows)
