import math

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import analytics as A
from corvane.operators import evaluation as E
from corvane.operators import matching as M
from corvane.operators import retrieval as R
from corvane.operators import scorecards as S

CAND = "id string, job_id string, score double, status string, created_at string"
EVID = "id string, candidate_id string, criterion_id string, criterion string, requirement_type string, weight double, result string, snippet string, page_number int"
REV = "id string, candidate_id string, reviewer string, role string, decision string, note string, created_at string"


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


@pytest.fixture
def job(spark):
    c = spark.createDataFrame([("a", "j", 90.0, "advance", "2024-01-01T00:00:00Z"), ("b", "j", 80.0, "advance", "2024-01-01T00:00:00Z"), ("c", "j", 60.0, "needs_info", ""), ("d", "j", 50.0, "not_selected", None), ("d", "j", 50.0, "not_selected", None)], CAND)
    r = spark.createDataFrame([("1", "a", "x", "Recruiter", "advance", "n1", "2024-01-02T00:00:00Z"), ("2", "a", "y", "hiring-manager", "needs_info", "n2", "2024-01-02T00:00:00Z"), ("3", "b", "x", "rec", "needs_info", "", "2024-01-01T00:00:00Z"), ("4", "b", "x", "rec", "advance", None, "2024-01-05T00:00:00+07:00")], REV)
    return c, r


def test_funnel_and_scores(spark, job):
    got = {(x.status, x.n, x.pct) for x in A.job_funnel(job[0]).collect()}
    assert got == {("needs_review", 0, 0.0), ("advance", 2, 50.0), ("needs_info", 1, 25.0), ("not_selected", 1, 25.0)}
    s = A.job_scores(job[0]).first()
    assert (s.n, s.avg_score, s.min_score, s.max_score) == (4, 70.0, 50.0, 90.0)
    assert A.job_funnel(job[0].limit(0)).count() == 0


def test_agreement(spark, job):
    x = A.agreement(job[1], job[0]).first()
    assert (x.n_dual, x.n_consensus, x.consensus_pct) == (1, 0, 0.0)
    assert [(d.candidate_id, d.recruiter, d.hiring_manager) for d in A.divergences(job[1], job[0]).collect()] == [("a", "advance", "needs_info")]


def test_kappa(spark):
    rows = [("adv", "adv"), ("adv", "adv"), ("not", "not"), ("info", "not"), (None, "adv")]
    k = A.cohen_kappa(spark.createDataFrame(rows, "l string, r string"), "l", "r").first()
    assert k.n == 4 and k.kappa == pytest.approx(0.6)
    same = spark.createDataFrame([("a", "a")] * 3, "l string, r string")
    assert A.cohen_kappa(same, "l", "r").first().kappa == 1.0
    assert A.cohen_kappa(same, "l", "r", degenerate="null").first().kappa is None


def test_health_and_grounding(spark, job):
    rows = [(f"s{i}", "a", "strict", "S", "required", 1.0, "matched" if i == 0 else "unknown", "t", 1) for i in range(10)]
    rows += [(f"c{i}", "a", "common", "C", "required", 1.0, "matched", "t", None) for i in range(10)]
    rows += [(f"b{i}", "a", "bal", "B", "required", 1.0, r, " ", 2) for i, r in enumerate(["matched"] * 5 + ["partial"] * 3 + ["unknown"] * 2)]
    e = spark.createDataFrame(rows + rows[:2], EVID)
    flags = {x.criterion_id: (x.flag, x.matched_pct, x.unknown_pct) for x in A.criteria_health(e, job[0]).collect()}
    assert flags == {"strict": ("bottleneck", 10.0, 90.0), "common": ("too_common", 100.0, 0.0), "bal": ("healthy", 50.0, 20.0)}
    g = A.grounding_audit(e, job[0]).first()
    assert (g.positives, g.grounded, g.attributed) == (19, 11, 9)


def test_ranking(spark):
    g = spark.createDataFrame([("a", "j", 90.0, None, 2, True), ("b", "j", 80.0, None, 1, True), ("c", "j", 50.0, None, 0, True), ("z", "k", 1.0, None, 0, True), ("w", "m", 1.0, None, 0, False)], "id string, job_id string, score double, at timestamp, rel int, reviewed boolean")
    q = {x.job_id: x for x in A.ranking_quality(g, 3).collect()}
    assert (q["j"].mrr, round(q["j"].ndcg, 6), round(q["j"].precision, 3)) == (1.0, 1.0, 0.667)
    assert (q["k"].ndcg, q["m"].ndcg, q["k"].mrr) == (1.0, 0.0, 0.0)
    worst = spark.createDataFrame([("a", "j", 1.0, None, 2, True), ("b", "j", 2.0, None, 0, True)], g.schema)
    x = A.ranking_quality(worst, 2).first()
    assert x.mrr == 0.5 and x.ndcg == pytest.approx((3 / math.log2(3)) / 3, abs=1e-6)


def test_shares_and_calibration(spark):
    n = spark.createDataFrame([("g", "a", 1), ("g", "b", 1), ("g", "c", 1), ("e", "a", 0)], "g string, c string, n bigint")
    units = {(x.g, x.c): x.units for x in A.largest_remainder(n, ["g"], "c", "n").collect()}
    assert units == {("g", "a"): 334, ("g", "b"): 333, ("g", "c"): 333, ("e", "a"): 0}
    crit = [("m", "Core", "required", 6.0), ("m", "x", "required", 1.0), ("m", "y", "preferred", 1.0), ("m", "z", "preferred", 0.8)] + [("s", str(i), "required", 1.0) for i in range(4)]
    v = {x.job_id: x.verdict for x in A.calibration(spark.createDataFrame(crit, "job_id string, label string, type string, weight double")).collect()}
    assert v == {"m": "unbalanced", "s": "too_strict"}


def test_matching(spark):
    docs = spark.createDataFrame([(1, "Senior Backend Engineer with extensive Python experience.\n\nused postgres db"), (2, "No experience with Python.\nBuilt APIs with Python."), (3, "Key stakeholder led the department's management transition."), (4, None), (5, "Not only used Python but Go")], "doc_id int, text string")
    crit = (M.Criterion("p", "Python", weight=2.0), M.Criterion("q", "PostgreSQL", aliases=("postgres",)), M.Criterion("s", "stakeholder management"))
    got = {(x.doc_id, x.criterion_id): (x.result, x.line_no) for x in M.match_criteria(M.document_lines(docs), crit).collect()}
    assert got[1, "p"] == ("matched", 0) and got[1, "q"] == ("matched", 1) and got[3, "s"] == ("partial", 0) and got[2, "p"] == ("matched", 0)
    live = {(x.doc_id, x.criterion_id): (x.result, x.snippet) for x in M.match_criteria(M.document_lines(docs), crit, profile="live").collect()}
    assert live[2, "p"] == ("needs_verification", "No experience with Python.") and live[5, "p"][0] == "matched"
    e = spark.createDataFrame([("c", "matched", 2.0), ("c", "partial", 1.0), ("c", "unknown", 1.0), ("z", "matched", 0.0)], "candidate_id string, result string, weight double")
    assert {x.candidate_id: x.score for x in M.score(e).collect()} == {"c": 62.5, "z": 0.0}


def test_text(spark):
    assert one(spark, "a@b.co, +62 812 3456 7890 and (2019 - 2023)", lambda c: T.redact_phone(T.redact_email(c))) == "[email removed], [phone removed] and (2019 - 2023)"
    assert one(spark, "Name: X\nEmail: y\nBuilt Go services", T.redact_for_evidence) == "Built Go services"
    assert one(spark, "DOB: 15/01/1990, built", T.redact_birth).startswith("[birth date removed]")
    assert one(spark, "5 years of Python experience; 12 years experience", T.experience_years) == 12
    assert one(spark, "Candidate is 30 years of age; has 3 years of Python experience.", T.experience_duration) == 3.0
    assert one(spark, "selama 1,5 tahun", T.experience_duration) == 1.5
    assert one(spark, "Saya berumur 30 tahun.", T.experience_duration) is None
    assert one(spark, "Menguasai C++, .NET, CI/CD pipeline, Node.js, dan FastAPI.", lambda c: T.tokenize(c, T.STOP_WORDS)) == ["menguasai", "c++", ".net", "ci/cd", "pipeline", "node.js", "fastapi"]
    assert one(spark, "wajib: Python", T.parse_criterion).type == "required" and one(spark, "Preferred | Go", T.parse_criterion).label == "Go"
    assert [one(spark, v, T.valid_score) for v in ("4.0", "4.5", "6", None, "x")] == [4, None, None, None, None]
    long = "filler " * 200 + "python here " + "filler " * 200
    x = one(spark, long, lambda c: T.focused_excerpt(c, ["python"]))
    assert "python" in x and len(x) <= 700
    assert one(spark, None, T.lines) == [] and one(spark, "a\r\n\r\n b c", T.lines) == ["a", " b", "c"]


def test_evaluation(spark):
    r = spark.createDataFrame([("g", f"i{k}", a, b) for k, (a, b) in enumerate(zip([1, 2, 3, 4, 5], [1, 1, 3, 4, 5], strict=True))], "g string, i string, m int, j int")
    tau = E.kendall_tau_b(r, "g", "i", "m", "j").first().tau
    assert tau == pytest.approx(9 / math.sqrt(10 * 9))
    x = E.top_k_overlap(r, "g", "i", "m", "j").first()
    assert (x.precision, x.recall) == (1.0, 1.0)
    assert E.competition_ranks_valid(r, "g", "j").first().valid
    assert not E.competition_ranks_valid(r.withColumn("j", F.col("j") + 1), "g", "j").first().valid
    cells = E.confusion(spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), (None, "b")], "x string, y string"), "x", "y")
    m = {v.label: (v.support, v.precision, v.recall) for v in E.label_metrics(cells).collect()}
    assert m == {"a": (2, 1.0, 0.5), "b": (1, 0.5, 1.0)}
    rows = [("en", f"c{i}") for i in range(5)] + [("id", f"d{i}") for i in range(5)] + [("fr", "e1"), ("fr", "e2")]
    s = E.stratified(spark.createDataFrame(rows, "lang string, c string"), ["lang"], "c", {"n": F.count(F.lit(1))}, hide="largest")
    assert {v.value for v in s.collect() if v.reported} == {"en"}
    w = spark.createDataFrame([("a b c".split(), "a x c d".split()), ([], ["q"])], "r array<string>, h array<string>").select(E.token_error(F.col("r"), F.col("h")).alias("e")).collect()
    assert [(v.e.edits, v.e.words) for v in w] == [(2, 3), (1, 0)]


def test_retrieval(spark):
    docs = spark.createDataFrame([("d1", "Python services run well. Budgets are reviewed in spring."), ("d2", "The kitchen team cooks."), ("d3", None)], "id string, t string")
    chunks = R.sentence_chunks(docs, "id", "t")
    q = spark.createDataFrame([("q", "python services"), ("e", "the")], "query_id string, text string")
    top = R.bm25(R.postings(chunks, ["id", "chunk_no"]), q, ["id", "chunk_no"], chunks.count(), 4.0, ["python"]).collect()
    assert [(x.query_id, x.id, x.chunk_no, x.matched) for x in top] == [("q", "d1", 0, 2)]
    assert R.overlap_rank(chunks, q, ["id", "chunk_no"]).first().overlap == 2


def test_scorecards(spark):
    cards = spark.createDataFrame([("1", "c", "recruiter", "hire"), ("2", "c", "HM", "hire")], "id string, candidate_id string, role string, overall_recommendation string")
    scores = spark.createDataFrame([("a", "1", "t", 4), ("b", "1", "s", 3), ("c", "2", "t", 5), ("d", "2", "s", 4), ("e", "2", "s", 9), ("f", "1", "s", None)], "id string, scorecard_id string, criterion_id string, score int")
    got = {(x.role, x.criterion_id): (x.mean, x.n) for x in S.interview_summary(cards, scores).collect()}
    assert got[None, None] == (4.0, 4) and got["recruiter", None] == (3.5, 2) and got["hiring_manager", None] == (4.5, 2) and got[None, "t"] == (4.5, 2)
    d = S.role_delta(cards, scores).first()
    assert (d.delta, d.sign) == (1.0, -1)


LIVE = (
    ("No experience with Python.", "needs_verification"), ("Not familiar with Python.", "needs_verification"), ("Lacked Python in the last role.", "needs_verification"),
    ("Didn't use Python.", "needs_verification"), ("Jarang memakai Python.", "needs_verification"), ("Belum pernah memakai Python", "needs_verification"),
    ("Not only used Python but also Go.", "matched"), ("Bukan hanya Python, juga Go.", "matched"), ("Kurang lebih 5 tahun memakai Python.", "matched"),
    ("No travel. Built APIs in Python.", "matched"), ("No one of all the eight people in the team knew how much Python mattered", "matched"),
    ("Name: Synthetic Candidate; Python engineer", "needs_verification"), ("No experience with Python.\nBuilt production APIs with Python.", "needs_verification"),
)


def test_live_profile(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LIVE)] + [(90, None), (91, "\n \n")], "doc_id int, text string")
    got = {x.doc_id: x for x in M.match_documents(docs, (M.Criterion("p", "Python"),), profile="live").collect()}
    assert {i: got[i].result for i in got} == {i: r for i, (_, r) in enumerate(LIVE)}
    assert got[11].snippet == "" and got[12].snippet == "No experience with Python." and got[12].line_no == 0
    part = M.match_documents(spark.createDataFrame([(1, "Key stakeholder led the department's management transition.")], "doc_id int, text string"), (M.Criterion("s", "stakeholder management"),), profile="live")
    assert [(x.result, x.confidence) for x in part.collect()] == [("partial", 0.5)]
    both = [sorted(map(str, M.match_documents(docs, (M.Criterion("p", "Python"),), profile=p).collect())) == sorted(map(str, M.match_criteria(M.document_lines(docs), (M.Criterion("p", "Python"),), profile=p).select("doc_id", "criterion_id", "criterion", "type", "weight", "result", "line_no", "snippet", "confidence").collect())) for p in ("live", "taxonomy")]
    assert both == [True, True]


def test_live_texts(spark):
    red = lambda t: one(spark, t, lambda c: T.redact_for_evidence(c, profile="live"))
    lines = "Nama lengkap: K S\nEmail: k@example.test\nNo. HP: +62 812-3456-7890\nTempat, Tanggal Lahir: Jakarta, 12 Mei 1994\nAlamat domisili: Jalan Contoh 17\nJenis Kelamin: Perempuan\nAgama: Islam\nUsia: 32\nNIK: 3174010212900001\nPaspor: X1234567\nDisabilitas: tidak ada\nPython services delivered."
    assert red(lines) == "Python services delivered."
    assert red("Python services; age: 32; berusia 31 tahun; 30 years old.").count("[age removed]") == 3
    assert "12 years of experience" in red("Python engineer with 12 years of experience.")
    x = red("Python engineer contact qa@example.com phone +1 555 010 2020 date of birth: 1994-03-12")
    assert "[email removed]" in x and "[phone removed]" in x and "1994-03-12" not in x
    years = {"Candidate is 30 years of age; has 3 years of Python experience.": 3.0, "Saya berumur 30 tahun.": None, "Dua puluh tahun pengalaman": 20.0, "1.5 years of work": 1.5, "a few years, then 5 years": None, "over two decades": 20.0, "Usia 30,5 tahun.": None, "age 30 years and five years of work": 5.0, "a couple of years": 2.0}
    assert {t: one(spark, t, T.experience_duration) for t in years} == years
    assert one(spark, "has 3 years here", T.duration_mention).text == "3 years"
    edu = {"Master of Business Administration (MBA)": ["Master of Business Administration", "MBA"], "S1 Informatika; Magister Manajemen; Doktor": ["S1", "Magister", "Doktor"], "Acted as scrum master here": [], "Name: Bachelor of Science\nAge: Master of Arts": [], "DOB: 20 Jan 1992 Education Bachelor of Science": ["Bachelor of Science"]}
    assert {t: one(spark, t, T.education_mentions) for t in edu} == edu
    assert one(spark, "No experience with Python. Go and React.js used; never Docker", T.live_skills) == ["go", "react", "react.js"]
    assert one(spark, "C++ and  machine\nlearning, react.js", lambda c: T.skills(c, ["machine learning", "c++", "react", "react.js", "node"])) == ["machine learning", "c++", "react", "react.js"]
    long = "filler " * 80 + "python here " + "filler " * 80 + "docker there " + "filler " * 80
    x = one(spark, long, lambda c: T.redact_for_evidence(c, profile="live", focus=F.array(F.lit("python"), F.lit("docker"))))
    assert len(x) <= 700 and "python" in x and "docker" in x and " … " in x


def test_retrieval_of_a_job(spark):
    jobs = spark.createDataFrame([("j", "Engineer", "Data", "Builds FastAPI services in Python. Reviews budgets."), ("j", "Engineer", "Data", "Builds FastAPI services in Python. Reviews budgets."), ("e", None, "", None)], "id string, title string, department string, description string")
    crit = spark.createDataFrame([("j", 0, "Python", "required", 2.0), ("j", 1, "Budget", "preferred", None), ("j", 2, " ", "required", 1.0)], "job_id string, position int, label string, type string, weight double")
    guides = spark.createDataFrame([(0, "Wajib: the same questions for all.", "Structured", 1.3)], "no int, text string, label string, source_weight double")
    rubrics = spark.createDataFrame([(0, "python", "Rubric: tests in Python."), (1, None, "Rubric ({}): a real case.")], "no int, keyword string, text string")
    custom = spark.createDataFrame([("j", "Policy", "Python is reviewed twice.", None)], "job_id string, label string, text string, source_weight double")
    chunks = R.job_chunks(jobs, crit, guides, rubrics, custom)
    assert {(x.job_id, x.source_type): x.n for x in chunks.groupBy("job_id", "source_type").agg(F.count("*").alias("n")).collect()} == {
        ("j", "position_meta"): 1, ("j", "job_description"): 2, ("j", "required_criterion"): 1, ("j", "preferred_criterion"): 1, ("j", "interview_rubric"): 4, ("e", "interview_rubric"): 1, ("j", "custom_knowledge"): 1,
    }
    q = (R.Query("a", "wajib Python"), R.Query("b", "fast"), R.Query("c", "the of"), R.Query("d", " ?! "))
    got = {}
    for x in R.retrieve(chunks, q, ("python",)).collect():
        got.setdefault((x.job_id, x.query_id), []).append((x.rank, x.source_type, x.matched))
    top = sorted(got["j", "a"])
    assert len(top) <= 5 and top[0][1] == "required_criterion" and top[0][2] == ["python"]
    assert sorted(got["j", "b"]) == [(1, "job_description", ["fast"])]  # within a longer word
    assert ("e", "a") in got and not [k for k in got if k[1] == "d"]
    assert R.retrieve(chunks, (R.Query("d", ""),)).count() == 0 and R.retrieve(chunks.limit(0), q).count() == 0
