from corvane.functions.instants import instant, key_text
from corvane.operators.references import Reference, broken_references, broken_rows, existence_deltas, fold, orphan_report, reference_deltas, reference_rows, suspects
from pyspark.sql import functions as F

S = "id string, candidate_id string, created_at string, key string, target string"


def test_instants(spark):
    texts = ["2024-01-03T00:00:00+00:00", "2024-01-03T07:00:00+07:00", "2024-01-03 00:00:00", "2024-01-03T00:00:00.000Z", " 2024-01-02T19:00:00-05:00 ", "2024-01-03", "2024-01-03T07:00:00+0700"]
    df = spark.createDataFrame([(t,) for t in [*texts, "", None, "soon"]], "t string")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Jakarta")
    try:
        got = [r.u for r in df.select(F.unix_seconds(instant(F.col("t"))).alias("u")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [1704240000] * 7 + [None] * 3


def test_keys(spark):
    df = spark.createDataFrame([(" A\t",), (" b ",), ("  ",), (None,)], "k string")
    assert [r.k for r in df.select(key_text(F.col("k")).alias("k")).collect()] == ["a", "b", None, None]


def _tables(spark):
    cands = spark.createDataFrame([("C1", None, "2024-01-02T00:00:00Z", "x", "y"), ("c1", None, "2024-01-05T00:00:00Z", "x", "y"), ("c2", None, "bad", "x", "y")], S)
    refs = spark.createDataFrame(
        [
            ("r1", " c1 ", "2024-01-02T07:00:00+07:00", "a", "b"),  # equal instant
            ("r2", "C1", "2024-01-01T00:00:00Z", "a", "b"),  # before
            ("r3", "gone", "2024-02-01T00:00:00Z", "a", "b"),
            ("r3", "gone", "2024-02-01T00:00:00Z", "a", "b"),  # copy
            ("r4", "c2", "2020-01-01T00:00:00Z", "a", "b"),
            ("r5", "", "2024-01-01T00:00:00Z", "a", "b"),
            ("r6", None, None, None, None),
            ("r7", "gone", None, "a", "b"),
            ("r8", "c1", None, "a", "b"),
        ],
        S,
    )
    return cands, refs


def test_broken(spark):
    cands, refs = _tables(spark)
    got = broken_references([Reference("t", refs, "candidate_id", "candidates")], {"candidates": cands})
    assert {(r.row_id, r.reason) for r in got.collect()} == {("r2", "later"), ("r3", "absent"), ("r7", "absent")}
    assert got.count() == 3
    report = {(r.reason, str(r.period)): (r.n_references, r.n_keys) for r in orphan_report(got).collect()}
    assert report == {("later", "2024-01-01"): (1, 1), ("absent", "2024-02-01"): (1, 1), ("absent", "None"): (1, 1)}


def test_empty_and_hot(spark):
    cands, refs = _tables(spark)
    none = broken_references([Reference("t", refs.limit(0), "candidate_id", "candidates")], {"candidates": cands})
    assert none.count() == 0
    every = broken_references([Reference("t", refs, "candidate_id", "candidates")], {"candidates": cands.limit(0)})
    assert {r.row_id for r in every.collect()} == {"r1", "r2", "r3", "r4", "r7", "r8"}
    hot = spark.range(20000).select(F.col("id").cast("string").alias("id"), F.lit("gone").alias("candidate_id"), F.lit("2024-01-01T00:00:00Z").alias("created_at"))
    assert broken_references([Reference("t", hot, "candidate_id", "candidates")], {"candidates": cands}).count() == 20000


def test_state_follows_deltas(spark):
    cands, refs = _tables(spark)
    rows = reference_rows([Reference("t", refs, "candidate_id", "candidates")])
    state = fold(reference_deltas(rows), existence_deltas("candidates", cands))
    assert {r.key for r in suspects(state).collect()} == {"c1", "gone"}
    came = fold(state, existence_deltas("candidates", spark.createDataFrame([("gone", None, "2020-01-01T00:00:00Z", "", "")], S)))
    assert {r.key for r in suspects(came).collect()} == {"c1"}
    went = fold(came, existence_deltas("candidates", cands.where("id = 'c2'"), sign=-1))
    assert {r.key for r in suspects(went).collect()} == {"c1", "c2"}


def test_deleted_and_back_again(spark):
    born = lambda at: spark.createDataFrame([("k", None, at, "", "")], S)
    refs = spark.createDataFrame([("r", "K", "2024-02-01T00:00:00Z", "", "")], S)
    rows = reference_rows([Reference("t", refs, "candidate_id", "candidates")])
    state = fold(reference_deltas(rows), existence_deltas("candidates", born("2024-01-01")))
    assert suspects(state).count() == 0
    gone = fold(state, existence_deltas("candidates", born("2024-01-01"), sign=-1))
    assert [(x.key, x.born, x.gone) for x in suspects(gone).collect()] == [("k", None, True)]
    assert [x.reason for x in broken_rows(rows, suspects(gone)).collect()] == ["deleted"]
    back = fold(gone, existence_deltas("candidates", born("2024-06-01")))
    assert [(str(x.born), x.gone) for x in suspects(back).collect()] == [("2024-06-01 00:00:00", False)]
    assert [x.reason for x in broken_rows(rows, suspects(back)).collect()] == ["later"]
    unnamed = fold(back, reference_deltas(rows, sign=-1))
    assert suspects(unnamed).count() == 0
