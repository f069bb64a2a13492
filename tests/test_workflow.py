import datetime as dt

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions.instants import long_date
from corvane.operators import analytics as A
from corvane.operators import evaluation as E
from corvane.operators import matching as M
from corvane.operators import packets as K
from corvane.operators import reports as P
from corvane.operators import roles as O
from corvane.operators import scorecards as S
from corvane.sources import readers as R
from corvane.sources import writers as W
from corvane.streaming import events as X

IDS = ["requisition_id", "candidate_id"]
CONTEXT = [*IDS, "criteria_version", "pipeline_version", "job_family"]


def master(spark, ranks=(1, 2, 3)):
    rows = [("job_" + "a" * 12, f"cand_{i:012x}", "v1", "p1", "eng", str(r), "") for i, r in enumerate(ranks)]
    return spark.createDataFrame(rows, "requisition_id string, candidate_id string, criteria_version string, pipeline_version string, job_family string, model_rank string, recruiter_rank string")


def test_masters(spark):
    m = master(spark)
    check = lambda df: {x.violation for x in K.master_violations(df, IDS, ["recruiter_rank"], "requisition_id", "model_rank").collect()}
    assert check(m) == set() and check(m.limit(0)) == set()
    assert check(m.unionByName(m.limit(1))) == {"duplicate_key", "incomplete_ranks"}
    assert check(master(spark, (1, 3, 3))) == {"incomplete_ranks"}
    assert check(m.withColumn("recruiter_rank", F.lit("1"))) == {"already_reviewed"}
    assert check(m.withColumn("job_family", F.col("candidate_id"))) == {"mixed_job_family"}
    assert check(m.withColumn("pipeline_version", F.col("candidate_id"))) == {"several_versions"}
    bad = K.form_violations(m.withColumn("criteria_version", F.when(F.col("model_rank") == "1", "1.0"))).collect()
    assert len(bad) == 3 and all(x.violations == ["criteria_version"] for x in bad)


def test_packets(spark, tmp_path):
    m = master(spark)
    (tmp_path / "m.csv").write_text("a,b\n1,2\n")
    lock = K.freeze(spark, str(tmp_path / "m.csv"))
    assert len(lock["run_id"]) == 32 and len(lock["master_sha256"]) == 64
    packet = K.prepare_packet(m, CONTEXT, "recruiter", lock["run_id"], ["reviewer_rank"], 7, "requisition_id")
    assert packet.columns == ["run_id", *CONTEXT, "reviewer_role", "reviewer_rank"] and packet.count() == 3
    with pytest.raises(ValueError):
        K.prepare_packet(m, CONTEXT, "boss", "r", [], 1)
    done = packet.join(m.select("candidate_id", "model_rank"), "candidate_id").withColumn("reviewer_rank", F.when(F.col("model_rank") == "3", "3").otherwise("1")).drop("model_rank")
    check = lambda df, role="recruiter": {x.violation for x in K.packet_violations(df, m, IDS, CONTEXT, role, lock["run_id"], "requisition_id", "reviewer_rank").collect()}
    assert check(done) == set()
    assert check(done, "hiring_manager") == {"other_role"}
    assert check(done.withColumn("run_id", F.lit("x"))) == {"other_run"}
    assert check(done.withColumn("job_family", F.lit("ops"))) == {"changed_context"}
    assert check(done.where("reviewer_rank = '1'")) == {"missing"}
    assert "doubled" in check(done.unionByName(done.limit(1))) and check(done.withColumn("reviewer_rank", F.lit("2"))) == {"bad_ranks"}
    assert "unknown" in check(done.withColumn("candidate_id", F.lit("cand_zzz")))


def test_merge_and_adjudication(spark):
    m = master(spark)
    sheet = m.select(*IDS, F.col("model_rank").alias("recruiter_rank"), F.lit("1").alias("hiring_manager_rank"), F.lit("1").alias("adjudicated_rank"))
    ranks = ["recruiter_rank", "hiring_manager_rank", "adjudicated_rank"]
    lock = K.ranks_digest(sheet, [*IDS, *ranks[:2]])
    assert lock == K.ranks_digest(sheet.repartition(5), [*IDS, *ranks[:2]]) != K.ranks_digest(sheet.limit(2), [*IDS, *ranks[:2]])
    out = K.apply_adjudication(m, sheet, IDS, ranks, ranks[:2], lock)
    assert out.count() == 3 and {x.adjudicated_rank for x in out.collect()} == {"1"}
    with pytest.raises(ValueError):
        K.apply_adjudication(m, sheet.withColumn("recruiter_rank", F.lit("9")), IDS, ranks, ranks[:2], lock)
    p = spark.createDataFrame([("c", "a1", "partial", "valid", 1), ("c", "a2", "supported", "missing", 2), ("d", "a1", None, None, 1)], "candidate_id string, annotator string, reviewer_label string, reference_label string, labelled_at int")
    new = K.newest_labels(p, ["candidate_id"], ["reviewer_label", "reference_label"])
    base = spark.createDataFrame([("c",), ("e",)], "candidate_id string")
    assert [tuple(x) for x in K.merge_packets(base, new, new, ["candidate_id"]).collect()] == [("c", "supported", "missing", "supported", "missing")]


def test_digests_and_paths(spark, tmp_path):
    for name, text in (("a/x.txt", "one"), ("b/y.txt", "two")):
        (tmp_path / name).parent.mkdir()
        (tmp_path / name).write_text(text)
    first = K.fingerprint(spark, str(tmp_path))
    assert K.fingerprint(spark, str(tmp_path)) == first and len(first) == 64
    (tmp_path / "b/y.txt").write_text("twp")
    assert K.fingerprint(spark, str(tmp_path)) != first
    assert K.outside("/tmp/x", "/root/repo") and K.file_digests(spark, str(tmp_path)).count() == 2
    with pytest.raises(ValueError):
        K.outside(str(tmp_path / "a"), str(tmp_path))
    df = spark.range(20)
    assert [x.id for x in K.shuffled(df, 1, ["id"]).collect()] == [x.id for x in K.shuffled(df, 1, ["id"]).collect()] != list(range(20))


def test_roles(spark):
    jobs = spark.createDataFrame([("1", "Senior Back-End Engineer", "IT"), ("2", "Akuntan", None), ("3", "", "Network"), ("4", None, None), ("5", "Mobile", "Software")], "id string, title string, department string")
    got = {x.id: x.k for x in jobs.select("id", O.role_key(F.col("title"), F.col("department")).alias("k")).collect()}
    assert got == {"1": "backend_developer", "2": "accountant", "3": "network_administrator", "4": "general", "5": "software_developer"}
    presets = spark.createDataFrame([("accountant", i, f"L{i}", "required" if i < 2 else "preferred") for i in range(8)] + [("general", 0, "G", "required")], "role string, no int, label string, type string")
    r = O.recommendations(jobs, presets).collect()
    assert len([x for x in r if x.job_id == "2"]) == 6 and {x.label for x in r if x.job_id == "1"} == {"G"} and {x.weight for x in r if x.type == "preferred"} == {0.8}
    bank = spark.createDataFrame([("sql", 0), ("data analysis", 1), ("programming", 2)], "key string, no int")
    aliases = spark.createDataFrame([("python", "programming", 0), ("bi", "data analysis", 1), ("x", "gone", 2)], "alias string, key string, no int")
    labels = spark.createDataFrame([("SQL",), ("Data-Analysis and SQL",), ("Python 3",), ("Cooking",), ("",), (None,), ("analysis",)], "label string")
    assert {x.label: x.template for x in O.best_template(labels, bank, aliases).collect()} == {"SQL": "sql", "Data-Analysis and SQL": "sql", "Python 3": "programming", "Cooking": None, "": None, None: None, "analysis": "data analysis"}


def test_lists(spark):
    c = spark.createDataFrame([("cand_12ab", "advance", "txt", '{"skills":["go"]}', 2.0, "2024"), ("cand_9999", "needs_info", "pdf", None, None, "2023")], "id string, status string, file_type string, profile_json string, score double, created_at string")
    assert [x.id for x in O.search(c, "GO").collect()] == ["cand_12ab"] == [x.id for x in O.search(c, "12AB").collect()]
    assert O.search(c, "", "needs_info").count() == 1 and O.search(c).count() == 2
    assert [x.id for x in O.in_order(c, "date_asc").collect()] == ["cand_9999", "cand_12ab"] == [x.id for x in O.in_order(c.withColumn("score", -F.coalesce("score", F.lit(9.0))), "score_asc").collect()]
    with pytest.raises(ValueError):
        O.in_order(c, "name_asc")
    e = spark.createDataFrame([("a", "k", "K", "matched"), ("b", "k", "K", "unknown"), ("a", "m", "M", "partial"), ("z", "k", "K", "partial")], "candidate_id string, criterion_id string, criterion string, result string")
    assert {x.criterion_id: (x.diverges, x.matched_and_unknown) for x in O.compared(e, ["a", "b"]).collect()} == {"k": (True, True), "m": (False, False)}
    with pytest.raises(ValueError):
        O.compared(e, ["a"])
    ordered = M.canonical_order(spark.createDataFrame([("a", 1.0, "2024-01-01T07:00:00+07:00"), ("b", 1.0, "2024-01-01T01:00:00Z"), ("c", 2.0, None)], "id string, score double, created_at string"))
    assert [x.id for x in ordered.collect()] == ["c", "a", "b"]


def test_scalars(spark):
    row = spark.createDataFrame([("<a & 'b'>", "Senior C++ Dev!", dt.date(2024, 3, 1))], "h string, s string, d date").select(T.html_escape(F.col("h")).alias("h"), T.safe_slug(F.col("s")).alias("s"), long_date(F.col("d")).alias("d")).first()
    assert tuple(row) == ("&lt;a &amp; &#x27;b&#x27;&gt;", "Senior_C_Dev_", "1 Maret 2024")
    k = spark.createDataFrame([(0.8096,), (0.61,), (0.0,), (-0.1,), (0.2094,)], "k double").select(A.kappa_band(F.col("k")).alias("b")).collect()
    assert [x.b for x in k] == ["almost perfect", "substantial", "slight", "poor", "slight"]
    g = spark.createDataFrame([("a", 3, 1.0), ("b", 2, 0.0), ("c", 1, 0.5)], "g string, n int, tau double")
    assert tuple(E.macro(g, ["tau"]).first()) == (2, 0.5)
    v = spark.createDataFrame([("c", "v1", "matched", 1.0), ("c", "v2", "unknown", 1.0)], "candidate_id string, variant string, result string, weight double")
    c = E.counterfactual(v.where("variant = 'v1'"), v, F.sum(F.when(F.col("result") == "matched", 100.0).otherwise(0.0))).first()
    assert (c.n, c["mean"], c["max"], c.unchanged) == (2, 50.0, 100.0, 1)


def test_feedback_and_ingest(spark):
    c = spark.createDataFrame([("cand_0001", "j", 50.0, "advance", "2024-01-01"), ("cand_0002", "j", None, None, None)], "id string, job_id string, score double, status string, created_at string")
    j = spark.createDataFrame([("j", "Engineer")], "id string, title string")
    e = spark.createDataFrame([("e1", "cand_0001", "k1", "Go", "required", 1.0, "partial", 0.5, " ", None), ("e2", "cand_0001", "k2", "SQL", "required", 2.0, "matched", 1.0, "wrote SQL", 1), ("e3", "cand_0001", "k3", "Rust", "preferred", 1.0, "unknown", 0.0, None, None)], "id string, candidate_id string, criterion_id string, criterion string, requirement_type string, weight double, result string, confidence double, snippet string, page_number int")
    r = spark.createDataFrame([("r1", "cand_0001", "Mira", "recruiter", "advance", " good ", "2024-01-02"), ("r2", "cand_0001", "Rolf", "", "advance", None, "2024-01-03")], "id string, candidate_id string, reviewer string, role string, decision string, note string, created_at string")
    got = {x.candidate_id: x for x in P.candidate_feedback(c, j, e, r).collect()}
    f = got["cand_0001"]
    assert [s.criterion for s in f.strengths] == ["SQL", "Go"] and "wrote SQL" in f.strengths[0].explanation and [g.criterion for g in f.growth_areas] == ["Rust"]
    assert f.decision_summary == "Goes on: Rolf, Mira (Recruiter) found the main criteria for Engineer met. Note: good" and f.label == "0001" and "Rust" in f.email
    assert got["cand_0002"].strengths == [] and got["cand_0002"].decision_summary == "Waits for a review."
    docs = spark.createDataFrame([(1, "Python since 2019\nfive years of work", "txt", dt.datetime(2024, 1, 1)), (2, None, "txt", None), (3, "No experience with Python.", "txt", dt.datetime(2024, 1, 1))], "doc_id long, text string, file_type string, received_at timestamp")
    new = P.ingest(docs, (M.Criterion("p", "Python"),), "j")
    assert sorted(x.score for x in new.candidates.collect()) == [0.0, 100.0] and new.evidence.count() == 2 and new.audit.count() == 2
    assert {x.result for x in new.evidence.collect()} == {"matched", "needs_verification"}
    assert P.ingest(docs, (M.Criterion("p", "Python"),), "j", known=new.candidates).candidates.count() == 0


def test_record_scorecards_and_cascade(spark):
    cards = spark.createDataFrame([("1", "j", "c", "Mira", "HM", "yes", "2024-01-01"), ("2", "j", "c", "", "recruiter", "", "2024-01-02"), ("3", "j", "c", "Rolf", "rec", None, "2024-01-03")], "id string, job_id string, candidate_id string, reviewer string, role string, overall_recommendation string, created_at string")
    scores = spark.createDataFrame([("a", "1", "t", "T", "4.0", ""), ("b", "1", "s", "S", "3", ""), ("c", "2", "t", "T", "5", ""), ("d", "3", "t", "T2", "9", "")], "id string, scorecard_id string, criterion_id string, criterion_label string, score string, evidence_notes string")
    good, kept, log, bad = S.record_scorecards(cards, scores)
    assert [x.id for x in good.collect()] == ["1"] and sorted(x.score for x in kept.collect()) == [3, 4] and log.count() == 1
    assert {x.id: x.violations for x in bad.collect()} == {"2": ["reviewer"], "3": ["values"]}
    p = S.interview_profile(cards, scores).first()
    assert p.reviewers == ["Mira", "", "Rolf"] and p.recommendations == ["yes"] and p.labels == {"t": "T2", "s": "S"}
    n = {x.id: len(x.scores) for x in S.nested_cards(cards, scores).collect()}
    assert n == {"1": 2, "2": 1, "3": 1}
    audit = W.audit_rows(cards, "seen", F.lit("x"), F.struct("role"))
    assert audit.count() == 3 and audit.select("id").collect() == W.audit_rows(cards, "seen", F.lit("x"), F.struct("role")).select("id").collect()
    left = W.delete_cascade({"candidates": spark.createDataFrame([("c", "j"), ("d", "j")], "id string, job_id string"), "audit_events": audit}, spark.createDataFrame([("c",), ("zz",)], "candidate_id string"))
    assert [x.id for x in left["candidates"].collect()] == ["d"] and [(x.event_type, x.candidate_id) for x in left["audit_events"].collect()] == [("candidate_deleted", "c")]


def test_sources(spark, tmp_path):
    for i, t in (("r00001", "one \n\n two"), ("r00002", "three")):
        (tmp_path / "d" / i).mkdir(parents=True)
        (tmp_path / "d" / i / "resume_text.txt").write_text(t)
        (tmp_path / "d" / i / "expected.json").write_text('{"skills": ["go"]}')
    (tmp_path / "m.json").write_text('[{"sample_id": "r00001"}, {"sample_id": "r00002"}]')
    m = R.manifest(spark, str(tmp_path / "m.json"), size=2)
    got = R.load_samples(spark, m, str(tmp_path / "d")).orderBy("sample_id", "line_no").collect()
    assert [(x.sample_id, x.page, x.line) for x in got] == [("r00001", None, "one"), ("r00001", None, "two"), ("r00002", None, "three")]
    with pytest.raises(ValueError):
        R.load_samples(spark, m.unionByName(spark.createDataFrame([("r00003",)], "sample_id string")), str(tmp_path / "d"))
    with pytest.raises(ValueError):
        R.manifest(spark, str(tmp_path / "m.json"), size=3)
    assert [x.sample_id for x in R.discover_samples(spark, str(tmp_path / "d")).collect()] == ["r00001", "r00002"] == [x.sample_id for x in R.discover_samples(spark, "", str(tmp_path / "m.json")).collect()]
    assert sorted(x.sample_id for x in R.expected_labels(spark, str(tmp_path / "d/*/expected.json")).collect()) == ["r00001", "r00002"]
    (tmp_path / "c.csv").write_text('ID,Resume_str,Resume_html,Category\n1,"two\nlines ""q""",<p>,HR\n')
    assert tuple(R.corpus_csv(spark, str(tmp_path / "c.csv")).first()) == ("1", 'two\nlines "q"', "HR")
    assert R.demo_rows(spark, [("a", "x"), ("b", "y")], spark.createDataFrame([("a",)], "id string")).count() == 1
    files = spark.createDataFrame([("p1", b"a\nb"), ("p2", b"!")], "path string, content binary")

    def parse(content):
        if content == b"!":
            raise RuntimeError("broken")
        return [(i, s) for i, s in enumerate(content.decode().split("\n"), 1)]

    out = R.external_lines(files, parse).orderBy("path", "line_no").collect()
    assert [(x.path, x.page, x.line, x.error) for x in out] == [("p1", 1, "a", None), ("p1", 2, "b", None), ("p2", None, None, "broken")]
    assert R.external_lines(files, None).where("error is not null").count() == 2 and (R.pdf_parser() is None or callable(R.pdf_parser()))
    pages = spark.createDataFrame([("p1", 1), ("p1", 2), ("p1", 3)], "path string, page int")
    assert tuple(R.page_coverage(R.external_lines(files, parse), pages).first()) == (1, 3, 2, 1)
    lines = R.external_lines(files, parse)
    assert {x.path: x.same for x in R.round_trip(lines, lines.where("line <> 'b'")).collect()} == {"p1": False} and R.round_trip(lines, lines).first().same


def test_rules_and_exports(spark, tmp_path):
    jobs = spark.createDataFrame([("T", [("L", "required")]), (" ", [("", "required")]), ("T", None)], "title string, criteria array<struct<label:string,type:string>>")
    good, bad = R.quarantine(R.capped(jobs.withColumn("title", F.repeat("title", 200))), R.job_rules())
    assert good.count() == 1 and len(good.first().title) == 160 and sorted(len(x.violations) for x in bad.collect()) == [1, 2]
    reviews = spark.createDataFrame([("a", "recruiter", "advance"), ("", "x", None)], "reviewer string, role string, decision string")
    assert [x.violations for x in R.quarantine(reviews, R.review_rules())[1].collect()] == [["reviewer", "role", "decision"]]
    df = spark.createDataFrame([(1, 'a"b'), (2, "x\ny")], "n int, t string")
    W.export_csv(df, str(tmp_path / "e"), [F.col("n")], mark=True)
    W.verify_export(spark, str(tmp_path / "e"), ["n", "t"], 2)
    with pytest.raises(ValueError):
        W.verify_export(spark, str(tmp_path / "e"), ["n", "t"], 3)
    W.snapshot(df, str(tmp_path / "s"))
    assert W.restore(spark, str(tmp_path / "s"), str(tmp_path / "back"), 2) == 2 == spark.read.parquet(str(tmp_path / "back")).count()
    with pytest.raises(RuntimeError):
        W.restore(spark, str(tmp_path / "s"), str(tmp_path / "other"), 5)
    assert not (tmp_path / "other").exists() and not (tmp_path / "other.staged").exists()
    new, version = W.migrate(df, [{"n": F.lit(0)}, {"status": F.lit("open")}])
    assert version == 2 and new.columns == ["n", "t", "status"] and new.first().n == 1
    log = spark.createDataFrame([("GET", "/a", 200, 0.5), ("GET", "/a", 200, 0.25)], "method string, route string, status int, seconds double")
    assert tuple(X.request_counts(log).first()) == ("GET", "/a", 200, 2, 0.75)


def test_logs_and_bounded_limits(spark, tmp_path):
    t = str(tmp_path / "log")
    step = X.append_current(t, "k", ["v"])
    step(spark.createDataFrame([("a", 1), ("b", 5)], "k string, v int"), 0)
    for _ in range(2):  # a repeated batch
        step(spark.createDataFrame([("a", 3), ("a", 2), ("b", 2)], "k string, v int"), 1)
    assert {(x.k, x.v) for x in X.read_current(spark, t, "k", ["v"]).collect()} == {("a", 3), ("b", 5)}
    X.compact(spark, t, str(tmp_path / "new"), "k", ["v"])
    X.append_current(str(tmp_path / "new"), "k", ["v"])(spark.createDataFrame([("b", 9)], "k string, v int"), 2)
    assert {(x.k, x.v) for x in X.read_current(spark, str(tmp_path / "new"), "k", ["v"]).collect()} == {("a", 3), ("b", 9)}
    X.ingest_batches(str(tmp_path / "in"), lambda b: {"rows": b, "keys": b.select("k")})(spark.createDataFrame([("a", 1)], "k string, v int"), 4)
    assert spark.read.parquet(str(tmp_path / "in/keys")).first().k == "a"
    rows = [("e", "x", f"2024-01-01T00:00:{s:02d}Z") for s in range(0, 40, 4)] + [("e", None, "2024-01-01T00:00:01Z")]
    spark.createDataFrame(rows, "id string, k string, created_at string").write.parquet(str(tmp_path / "s"))
    stream = X.read_stream(spark, str(tmp_path / "s"), "id string, k string, created_at string")
    q = X.admit_bounded(stream, "k", "created_at", 20, 3).writeStream.format("memory").queryName("bounded").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    out = spark.table("bounded").collect()
    assert sorted(x["at"] % 60 for x in out if x.key == "x" and x.admitted) == [0, 4, 8, 20, 24, 28] and [x.admitted for x in out if x.key is None] == [True]
