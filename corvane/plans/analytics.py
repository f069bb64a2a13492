"""Queries of the analytics operators over whole tables, with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions.instants import instant
from corvane.operators import analytics as A
from corvane.operators import evaluation as E
from corvane.operators import matching as M
from corvane.operators import packets as K
from corvane.operators import retrieval as R
from corvane.operators import roles as O
from corvane.operators import scorecards as S
from corvane.operators.positions import positions
from corvane.sources import writers as W
from corvane.session import spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

AT = r"TRY_CAST(CASE WHEN regexp_matches(trim({0}), '(Z|[+-]\d\d:\d\d)$') THEN trim({0}) ELSE trim({0}) || '+00:00' END AS TIMESTAMPTZ)"
CAND = f"""cand AS (SELECT DISTINCT id, job_id, CASE WHEN isnan(score) THEN NULL ELSE score END score,
  CASE WHEN status IS NULL OR status = '' THEN 'needs_review' ELSE trim(status) END status, {AT.format('created_at')} "at" FROM candidates)"""
ROLE = "CASE WHEN replace(replace(lower(trim(role)), ' ', '_'), '-', '_') IN ('rec', 'recruiter') THEN 'recruiter' WHEN replace(replace(lower(trim(role)), ' ', '_'), '-', '_') IN ('hm', 'hiring_manager') THEN 'hiring_manager' ELSE replace(replace(lower(trim(role)), ' ', '_'), '-', '_') END"
REV = f"""rev AS (SELECT DISTINCT id, candidate_id, {ROLE} "role", reviewer, decision, {AT.format('created_at')} "at" FROM reviews),
lastr AS (SELECT * FROM rev QUALIFY row_number() OVER (PARTITION BY candidate_id, "role" ORDER BY "at" DESC NULLS LAST, id DESC) = 1),
lastc AS (SELECT * FROM rev QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY "at" DESC NULLS LAST, id DESC) = 1),
dual AS (SELECT candidate_id, max(decision) FILTER ("role" = 'recruiter') recruiter, max(decision) FILTER ("role" = 'hiring_manager') hiring_manager FROM lastr GROUP BY 1
  HAVING max(decision) FILTER ("role" = 'recruiter') IS NOT NULL AND max(decision) FILTER ("role" = 'hiring_manager') IS NOT NULL)"""
EVID = """ev AS (SELECT e.*, c.job_id FROM (SELECT DISTINCT id, candidate_id, criterion_id, criterion, requirement_type, weight, result, snippet, page_number FROM evidence) e
  JOIN (SELECT DISTINCT id, job_id FROM candidates) c ON e.candidate_id = c.id)"""


def pct(n: str, d: str) -> str:
    return f"CASE WHEN {d} > 0 THEN CAST((2000 * ({n}) + {d}) // (2 * {d}) AS DOUBLE) / 10 ELSE 0.0 END"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# ---- text and matching

CRITERIA = (
    M.Criterion("c1", "Python", "required", 2.0), M.Criterion("c2", "PostgreSQL", "required", 2.0, ("postgres", "sql")),
    M.Criterion("c3", "budget review", "preferred", 1.0), M.Criterion("c4", "incident handbook", "preferred", 1.0),
)
_LINES = r"""lines AS (SELECT doc_id, i - 1 line_no, lower(regexp_replace(replace(replace(l, '–', '-'), '—', '-'), '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) l FROM (
  SELECT doc_id, unnest(ls) l, generate_subscripts(ls, 1) i FROM (
    SELECT doc_id, list_filter(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'), lambda x: regexp_replace(x, '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', '', 'g') <> '') ls FROM documents WHERE text IS NOT NULL)))"""


def _hit(word: str) -> str:
    return rf"regexp_matches(l, '(^|\W){word}(\W|$)')"


_MATCH = (
    "WITH "
    + _LINES
    + ", g AS (SELECT doc_id, c, max(grade) grade FROM (SELECT doc_id, unnest(["
    + ", ".join(
        f"{{'c': '{c}', 'grade': CASE WHEN {e} THEN 2 WHEN {p} THEN 1 ELSE 0 END}}"
        for c, e, p in (
            ("c1", _hit("python"), "false"),
            ("c2", " OR ".join(_hit(w) for w in ("postgresql", "postgres", "sql")), "false"),
            ("c3", _hit("budget review"), f"{_hit('budget')} AND {_hit('review')}"),
            ("c4", _hit("incident handbook"), f"{_hit('incident')} AND {_hit('handbook')}"),
        )
    )
    + "], recursive := true) FROM lines) GROUP BY ALL)"
)


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


@query(
    "lexical_score_topk",
    _MATCH + """, s AS (SELECT doc_id, 100.0 * sum((CASE grade WHEN 2 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END) * (CASE WHEN c IN ('c1', 'c2') THEN 2.0 ELSE 1.0 END)) / 6.0 score FROM g GROUP BY 1)
SELECT source, doc_id, CAST(score AS DOUBLE) score, CAST(rank AS INT) "rank" FROM (SELECT d.source, s.doc_id, s.score, row_number() OVER (PARTITION BY d.source ORDER BY s.score DESC, s.doc_id) rank FROM s JOIN documents d USING (doc_id)) WHERE rank <= 10""",
)
def lexical_score_topk(spark: SparkSession, d: str) -> DataFrame:
    """Lines, criteria, weighted score, and the ten best documents of every source."""
    from pyspark.sql import Window

    s = M.score_documents(spread(table(spark, d, "documents").select("doc_id", "source", "text")), CRITERIA, ("doc_id", "source"))
    w = Window.partitionBy("source").orderBy(F.desc("score"), "doc_id")
    return s.withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("source", "doc_id", "score", "rank")


@query("criteria_matches", _MATCH + " SELECT doc_id, c criterion_id, CASE grade WHEN 2 THEN 'matched' WHEN 1 THEN 'partial' ELSE 'unknown' END result FROM g")
def criteria_matches(spark: SparkSession, d: str) -> DataFrame:
    return M.match_documents(_texts(spark, d), CRITERIA).select("doc_id", "criterion_id", "result")


@query("live_matches")
def live_matches(spark: SparkSession, d: str) -> DataFrame:
    """The live profile: denied mentions need verification, with the deciding line and its redacted snippet."""
    return M.match_documents(_texts(spark, d), CRITERIA, profile="live")


@query("line_stats", "WITH " + _LINES + " SELECT doc_id, count(*) n_lines FROM lines GROUP BY 1")
def line_stats(spark: SparkSession, d: str) -> DataFrame:
    return M.document_lines(table(spark, d, "documents").select("doc_id", "text")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))


@query("redact_email", r"SELECT DISTINCT id, regexp_replace(snippet, '\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b', '[email removed]', 'g') snippet FROM evidence")
def redact_email(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "evidence").select("id", T.redact_email(F.col("snippet")).alias("snippet")).distinct()


@query("redact_for_evidence")
def redact_for_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Snippets without lines of personal data, addresses, phones and birth dates, cut at 700."""
    return table(spark, d, "evidence").select("id", T.redact_for_evidence(F.col("snippet")).alias("snippet")).distinct()


@query("focused_excerpts")
def focused_excerpts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.focused_excerpt(F.col("text"), ["python", "budget"]).alias("excerpt"))


@query("experience_years")
def experience_years(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.experience_years(t).alias("years"), T.experience_duration(t).alias("duration"), T.education_levels(t, T.EDUCATION).alias("education"))


SKILLS = ("python", "sql", "docker", "kubernetes", "kafka", "react", "figma", "excel", "sap", "tableau", "go", "rust", "c#", "c++", ".net", "ci/cd")


@query(
    "skill_frequency",
    "WITH t AS (SELECT doc_id, lower(text) l FROM documents WHERE text IS NOT NULL), s AS (SELECT unnest(["
    + ", ".join(f"'{s}'" for s in SKILLS)
    + r"]) skill) SELECT skill, count(*) n FROM t, s WHERE regexp_matches(l, '(^|[^\w])' || regexp_replace(skill, '([.+#])', '\\\1', 'g') || '([^\w]|$)') GROUP BY 1",
)
def skill_frequency(spark: SparkSession, d: str) -> DataFrame:
    """Documents that name each skill."""
    s = _texts(spark, d).select("doc_id", F.explode(T.skills(F.col("text"), SKILLS)).alias("skill"))
    return s.groupBy("skill").agg(F.count(F.lit(1)).alias("n"))


@query(
    "coverage",
    "SELECT count(*) n, " + pct("count(*) FILTER (regexp_matches(lower(text), '(^|[^\\w])(python|sql|docker)([^\\w]|$)'))", "count(*)") + " skills_pct FROM documents WHERE text IS NOT NULL",
)
def coverage(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null").select(T.skills(F.col("text"), ("python", "sql", "docker")).alias("s"))
    return t.agg(F.count(F.lit(1)).alias("n"), A.percent(F.count_if(F.size("s") > 0), F.count(F.lit(1))).alias("skills_pct"))


@query("tokens_per_document")
def tokens_per_document(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(T.tokenize(F.col("text"), T.STOP_WORDS)).alias("n_tokens"), F.size(T.split_sentences(F.col("text"))).alias("n_sentences"))


@query("review_roles", f'SELECT {ROLE} "role", count(*) n FROM (SELECT DISTINCT id, role FROM reviews) GROUP BY 1')
def review_roles(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reviews").select("id", T.normalize_role(F.col("role")).alias("r"), "role").distinct()
    return r.groupBy(F.col("r").alias("role")).agg(F.count(F.lit(1)).alias("n"))


@query("valid_scores", "SELECT DISTINCT id, CASE WHEN score BETWEEN 1 AND 5 THEN score END score FROM interview_criterion_scores")
def valid_scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "interview_criterion_scores").select("id", T.valid_score(F.col("score")).alias("score")).distinct()


@query("search_candidates", "SELECT DISTINCT id FROM candidates WHERE contains(lower(id), 'a7') OR coalesce(contains(lower(profile_json), 'kafka'), false) OR coalesce(contains(lower(file_type), 'kafka'), false)")
def search_candidates(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidates")
    return c.where(T.contains_text("a7", F.col("id")) | T.contains_text("kafka", F.col("profile_json"), F.col("file_type"))).select("id").distinct()


# ---- jobs, candidates, reviews


@query(
    "job_funnel",
    f"""WITH {CAND}, z AS (SELECT job_id, status, count(*) n FROM cand GROUP BY ALL UNION ALL SELECT DISTINCT job_id, unnest(['needs_review', 'advance', 'needs_info', 'not_selected']), 0 FROM cand),
p AS (SELECT job_id, status, CAST(sum(n) AS BIGINT) n FROM z GROUP BY ALL), t AS (SELECT *, CAST(sum(n) OVER (PARTITION BY job_id) AS BIGINT) t FROM p)
SELECT job_id, status, n, {pct('n', 't')} pct FROM t""",
)
def job_funnel(spark: SparkSession, d: str) -> DataFrame:
    return A.job_funnel(table(spark, d, "candidates"))


@query("job_scores", f"WITH {CAND} SELECT job_id, count(*) n, CAST(sum(CAST(score AS DECIMAL(18,6))) AS DOUBLE) / nullif(count(score), 0) avg_score, min(score) min_score, max(score) max_score FROM cand GROUP BY 1")
def job_scores(spark: SparkSession, d: str) -> DataFrame:
    return A.job_scores(table(spark, d, "candidates"))


@query("jobs_with_counts", "SELECT j.id job_id, j.title, coalesce(n, 0) n_candidates FROM (SELECT DISTINCT id, title FROM jobs) j LEFT JOIN (SELECT job_id, count(DISTINCT id) n FROM candidates GROUP BY 1) c ON j.id = c.job_id")
def jobs_with_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.jobs_with_counts(table(spark, d, "jobs"), table(spark, d, "candidates"))


@query("status_counts", f"WITH {CAND} SELECT status, count(*) n FROM cand GROUP BY 1")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.scored(table(spark, d, "candidates")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("latest_reviews", f'WITH {REV} SELECT candidate_id, "role", reviewer, decision FROM lastr')
def latest_reviews(spark: SparkSession, d: str) -> DataFrame:
    return A.latest_reviews(table(spark, d, "reviews").distinct()).drop("at")


@query("review_agreement", f"WITH {REV} SELECT c.job_id, count(*) n_dual, count(*) FILTER (recruiter = hiring_manager) n_consensus, {pct('count(*) FILTER (recruiter = hiring_manager)', 'count(*)')} consensus_pct FROM dual JOIN (SELECT DISTINCT id, job_id FROM candidates) c ON dual.candidate_id = c.id GROUP BY 1")
def review_agreement(spark: SparkSession, d: str) -> DataFrame:
    return A.agreement(table(spark, d, "reviews"), table(spark, d, "candidates"))


@query("divergences", f"WITH {REV}, {CAND} SELECT candidate_id, recruiter, hiring_manager, job_id, score, status FROM dual JOIN cand ON dual.candidate_id = cand.id WHERE recruiter <> hiring_manager")
def divergences(spark: SparkSession, d: str) -> DataFrame:
    return A.divergences(table(spark, d, "reviews"), table(spark, d, "candidates"))


_KAPPA = """, pr AS (SELECT {keys} l, r, count(*) n FROM pairs GROUP BY ALL),
tot AS (SELECT {keys} sum(n) n, sum(n) FILTER (l = r) same FROM pr GROUP BY ALL),
pe AS (SELECT {akeys} sum(a.n * b.n) ab FROM (SELECT {keys} l c, sum(n) n FROM pr GROUP BY ALL) a JOIN (SELECT {keys} r c, sum(n) n FROM pr GROUP BY ALL) b USING ({ukeys} c) GROUP BY ALL)"""


@query(
    "reviewer_kappa",
    f"WITH {REV}, pairs AS (SELECT recruiter l, hiring_manager r FROM dual)"
    + _KAPPA.format(keys="", akeys="", ukeys="")
    + """ SELECT CAST(n AS BIGINT) n, CAST(coalesce(same, 0) AS DOUBLE) / n observed, CAST(coalesce(ab, 0) AS DOUBLE) / (CAST(n AS DOUBLE) * n) expected,
  round((CAST(coalesce(same, 0) AS DOUBLE) / n - CAST(coalesce(ab, 0) AS DOUBLE) / (CAST(n AS DOUBLE) * n)) / (1.0 - CAST(coalesce(ab, 0) AS DOUBLE) / (CAST(n AS DOUBLE) * n)), 9) kappa FROM tot, pe""",
)
def reviewer_kappa(spark: SparkSession, d: str) -> DataFrame:
    return A.cohen_kappa(A.role_pairs(table(spark, d, "reviews")), "recruiter", "hiring_manager").withColumn("kappa", F.round("kappa", 9))


@query("status_from_reviews", f"WITH {REV}, {CAND} SELECT cand.id candidate_id, coalesce(lastc.decision, 'needs_review') status FROM cand LEFT JOIN lastc ON cand.id = lastc.candidate_id")
def status_from_reviews(spark: SparkSession, d: str) -> DataFrame:
    last = A.latest_reviews(table(spark, d, "reviews").distinct(), by_role=False)
    c = table(spark, d, "candidates").select(F.col("id").alias("candidate_id")).distinct()
    return c.join(last, "candidate_id", "left").select("candidate_id", F.coalesce("decision", F.lit("needs_review")).alias("status"))


@query("candidates_without_review", "SELECT DISTINCT id FROM candidates WHERE id NOT IN (SELECT candidate_id FROM reviews WHERE candidate_id IS NOT NULL)")
def candidates_without_review(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidates").select("id").distinct().join(table(spark, d, "reviews").select(F.col("candidate_id").alias("id")).distinct(), "id", "left_anti")


@query("score_distribution", f"""WITH {CAND} SELECT job_id, count(score) n, min(score) "min", max(score) "max", CAST(sum(CAST(score AS DECIMAL(18,6))) AS DOUBLE) / count(score) mean, median(score) median,
 round(CASE WHEN count(score) > 1 THEN stddev_samp(score) ELSE 0.0 END, 6) stdev, round(quantile_cont(score, 0.9), 9) p90, count(*) FILTER (score >= 80) from_80, count(*) FILTER (score >= 60 AND score < 80) from_60,
 count(*) FILTER (score >= 40 AND score < 60) from_40, count(*) FILTER (score >= 20 AND score < 40) from_20, count(*) FILTER (score < 20) from_0 FROM cand WHERE score IS NOT NULL GROUP BY 1""")
def score_distribution(spark: SparkSession, d: str) -> DataFrame:
    return A.score_distribution(table(spark, d, "candidates")).withColumn("p90", F.round("p90", 9))


@query("status_shares", f"""WITH {CAND}, n AS (SELECT job_id, status, count(*) n FROM cand GROUP BY ALL), f AS (SELECT *, CAST(sum(n) OVER (PARTITION BY job_id) AS BIGINT) t FROM n),
g AS (SELECT *, n * 1000 // t f, n * 1000 % t r FROM f), h AS (SELECT *, 1000 - sum(f) OVER (PARTITION BY job_id) rest, row_number() OVER (PARTITION BY job_id ORDER BY r DESC, status) p FROM g)
SELECT job_id, status, n, CAST(f + CASE WHEN p <= rest THEN 1 ELSE 0 END AS BIGINT) units FROM h""")
def status_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares in whole tenths of a percent that add up to 100."""
    n = A.scored(table(spark, d, "candidates")).groupBy("job_id", "status").agg(F.count(F.lit(1)).alias("n"))
    return A.largest_remainder(n, ["job_id"], "status", "n")


@query("alignment_pivot", f"""WITH {CAND} SELECT job_id, {', '.join(f"CAST(sum(CAST(score AS DECIMAL(18,6))) FILTER (status = '{s}') AS DOUBLE) / nullif(count(score) FILTER (status = '{s}'), 0) {s}" for s in A.STATUSES)} FROM cand GROUP BY 1""")
def alignment_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Mean score of every job by status, as columns."""
    c = A.scored(table(spark, d, "candidates"))
    mean = A.exact_sum(F.col("score")) / F.nullif(F.count("score"), F.lit(0))
    return c.groupBy("job_id").pivot("status", list(A.STATUSES)).agg(mean)


# ---- evidence


@query("criteria_health", f"""WITH {EVID}, c AS (SELECT job_id, criterion_id, min(criterion) criterion, count(*) FILTER (result = 'matched') matched, count(*) FILTER (result = 'partial') "partial", count(*) FILTER (result = 'unknown') "unknown" FROM ev GROUP BY 1, 2),
p AS (SELECT *, matched + "partial" + "unknown" evaluated FROM c), q AS (SELECT *, {pct('matched', 'evaluated')} matched_pct, {pct('"partial"', 'evaluated')} partial_pct, {pct('"unknown"', 'evaluated')} unknown_pct FROM p)
SELECT *, CASE WHEN unknown_pct > 80 THEN 'bottleneck' WHEN matched_pct > 90 THEN 'too_common' ELSE 'healthy' END flag FROM q""")
def criteria_health(spark: SparkSession, d: str) -> DataFrame:
    return A.criteria_health(table(spark, d, "evidence"), table(spark, d, "candidates"))


@query("grounding_audit", f"""WITH {EVID}, e AS (SELECT *, result IN ('matched', 'partial') pos, trim(coalesce(snippet, '')) t FROM ev),
c AS (SELECT job_id, count(*) n_rows, count(*) FILTER (pos) positives, count(*) FILTER (pos AND t <> '' AND t <> '[redacted]') grounded, count(*) FILTER (pos AND page_number IS NOT NULL) attributed, sum(CASE WHEN pos THEN length(t) ELSE 0 END) chars FROM e GROUP BY 1)
SELECT job_id, n_rows, positives, grounded, attributed, CASE WHEN positives > 0 THEN {pct('grounded', 'positives')} ELSE 100.0 END faithfulness, CASE WHEN positives > 0 THEN {pct('attributed', 'positives')} ELSE 100.0 END attribution,
 CAST(chars AS DOUBLE) / nullif(positives, 0) mean_chars FROM c""")
def grounding_audit(spark: SparkSession, d: str) -> DataFrame:
    return A.grounding_audit(table(spark, d, "evidence"), table(spark, d, "candidates"))


@query("pii_audit", rf"""WITH {EVID}, c AS (SELECT job_id, count(*) positives, count(*) FILTER (regexp_matches(snippet, '\b[\w.+-]+@[\w.-]+\.[A-Za-z]{{2,}}\b')) leaks FROM ev WHERE result IN ('matched', 'partial') GROUP BY 1)
SELECT *, {pct('positives - leaks', 'positives')} compliance FROM c""")
def pii_audit(spark: SparkSession, d: str) -> DataFrame:
    return A.pii_audit(table(spark, d, "evidence"), table(spark, d, "candidates"))


@query("weighted_scores", """SELECT candidate_id, 100.0 * sum((CASE result WHEN 'matched' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0.0 END) * weight) / coalesce(nullif(sum(weight), 0), 1) score, count(*) n_criteria
FROM (SELECT DISTINCT id, candidate_id, result, weight FROM evidence) GROUP BY 1""")
def weighted_scores(spark: SparkSession, d: str) -> DataFrame:
    return M.score(table(spark, d, "evidence").select("id", "candidate_id", "result", "weight").distinct())


@query("candidate_export", f"""WITH {CAND}, {REV}, e AS (SELECT candidate_id, count(*) FILTER (result = 'matched') matched, count(*) FILTER (result = 'partial') "partial", count(*) FILTER (result = 'unknown') "unknown" FROM (SELECT DISTINCT id, candidate_id, result FROM evidence) GROUP BY 1)
SELECT cand.id candidate_id, job_id, score, status, coalesce(matched, 0) matched, coalesce("partial", 0) "partial", coalesce("unknown", 0) "unknown", coalesce(nullif(trim(reviewer), ''), '-') reviewer, coalesce(nullif(trim("role"), ''), '-') "role", coalesce(nullif(trim(decision), ''), '-') decision
FROM cand LEFT JOIN e ON cand.id = e.candidate_id LEFT JOIN lastc ON cand.id = lastc.candidate_id""")
def candidate_export(spark: SparkSession, d: str) -> DataFrame:
    return A.candidate_counts(table(spark, d, "candidates"), table(spark, d, "evidence"), table(spark, d, "reviews").distinct())


@query("evidence_export", "SELECT DISTINCT id, candidate_id, criterion, requirement_type, result, coalesce(CAST(page_number AS VARCHAR), '') page, coalesce(snippet, '') snippet FROM evidence")
def evidence_export(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "evidence")
    return e.select("id", "candidate_id", "criterion", "requirement_type", "result", F.coalesce(F.col("page_number").cast("string"), F.lit("")).alias("page"), F.coalesce("snippet", F.lit("")).alias("snippet")).distinct()


@query("comparison_divergence", """SELECT criterion_id, count(DISTINCT result) n_results, count(DISTINCT result) > 1 diverges, bool_or(result = 'matched') AND bool_or(result = 'unknown') matched_and_unknown FROM evidence GROUP BY 1""")
def comparison_divergence(spark: SparkSession, d: str) -> DataFrame:
    return A.comparison_divergence(table(spark, d, "evidence"))


@query("joined_notes", """SELECT candidate_id, string_agg(note, ' | ' ORDER BY created_at DESC, id DESC) notes FROM (SELECT DISTINCT id, candidate_id, created_at, note FROM reviews WHERE trim(note) <> '') GROUP BY 1""")
def joined_notes(spark: SparkSession, d: str) -> DataFrame:
    return W.joined_notes(table(spark, d, "reviews"))


_CRIT = """RECURSIVE t(row_id, p, v) AS (SELECT id, '$', CAST(criteria_json AS JSON) FROM jobs WHERE json_valid(criteria_json) UNION SELECT row_id, p, w FROM (
  SELECT row_id, p, CAST(v ->> '$' AS JSON) w FROM t WHERE json_type(v) = 'VARCHAR' AND json_valid(v ->> '$')
  UNION ALL SELECT row_id, '$.criteria', json_extract(v, '$.criteria') FROM t WHERE p = '$' AND json_type(v) = 'OBJECT' AND list_contains(json_keys(v), 'criteria'))),
crit AS (SELECT DISTINCT row_id job_id, p, i, o ->> '$.label' "label", o ->> '$.type' "type", TRY_CAST(o ->> '$.weight' AS DOUBLE) w FROM (SELECT row_id, p, i, json_extract(v, '$[' || i || ']') o FROM (SELECT *, unnest(range(json_array_length(v)::BIGINT)) i FROM t WHERE json_type(v) = 'ARRAY')) WHERE json_type(o) = 'OBJECT')"""


@query("criteria_calibration", f"""WITH {_CRIT}, x AS (SELECT *, greatest(coalesce(w, 0), 0) g, coalesce("type", '') = 'required' req FROM crit),
s AS (SELECT job_id, count("label") n, CAST(sum(CAST(g AS DECIMAL(18,6))) AS DOUBLE) total, CAST(sum(CASE WHEN req THEN CAST(g AS DECIMAL(18,6)) ELSE 0 END) AS DOUBLE) r, max(g) m, count(*) FILTER (NOT req AND "label" IS NOT NULL) np FROM x GROUP BY 1),
u AS (SELECT *, CASE WHEN total > 0 THEN r / total ELSE 0 END required_share, CASE WHEN total > 0 THEN m / total ELSE 0 END largest_share FROM s)
SELECT job_id, n, total, required_share, largest_share, CASE WHEN n = 0 OR total <= 0 THEN 'empty' WHEN largest_share > 0.40 THEN 'unbalanced' WHEN np = 0 OR required_share >= 0.90 THEN 'too_strict' WHEN r < total - r THEN 'too_loose' WHEN n < 3 THEN 'too_few' WHEN n > 8 THEN 'too_many' ELSE 'well_calibrated' END verdict FROM u""")
def criteria_calibration(spark: SparkSession, d: str) -> DataFrame:
    from corvane.operators.nested import child_table, flatten_json
    from corvane.plans.records import CRITERIA

    nodes = child_table(flatten_json(table(spark, d, "jobs"), "criteria_json"), CRITERIA, {"label": "string", "type": "string", "weight": "double"}).distinct()
    return A.calibration(nodes.withColumnRenamed("row_id", "job_id"))


# ---- ranking


@query("ranking_quality", f"""WITH {CAND}, {REV}, g AS (SELECT cand.id, job_id, score, "cand"."at" a, CASE decision WHEN 'advance' THEN 2 WHEN 'needs_info' THEN 1 ELSE 0 END rel, decision IS NOT NULL reviewed FROM cand LEFT JOIN lastc ON cand.id = lastc.candidate_id WHERE job_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY score DESC NULLS LAST, a ASC NULLS FIRST, id) rn, row_number() OVER (PARTITION BY job_id ORDER BY rel DESC) ir FROM g),
s AS (SELECT job_id, count(*) n, count(*) FILTER (reviewed) nr, min(rn) FILTER (rel >= 1) f, CAST(sum(CAST((2 ** rel - 1) / log2(rn + 1) AS DECIMAL(20,10))) FILTER (rn <= 10) AS DOUBLE) dcg, CAST(sum(CAST((2 ** rel - 1) / log2(ir + 1) AS DECIMAL(20,10))) FILTER (ir <= 10) AS DOUBLE) ideal, count(*) FILTER (rn <= 10 AND rel >= 1) hits FROM r GROUP BY 1)
SELECT job_id, n, round(CASE WHEN f IS NULL THEN 0.0 ELSE 1.0 / f END, 6) mrr, round(CASE WHEN ideal > 0 THEN dcg / ideal WHEN nr > 0 THEN 1.0 ELSE 0.0 END, 6) ndcg, round(CAST(hits AS DOUBLE) / least(10, n), 6) "precision" FROM s""")
def ranking_quality(spark: SparkSession, d: str) -> DataFrame:
    q = A.ranking_quality(A.relevance(table(spark, d, "candidates"), table(spark, d, "reviews").distinct()), 10)
    return q.select("job_id", "n", *[F.round(c, 6).alias(c) for c in ("mrr", "ndcg", "precision")])


def _ranks(spark: SparkSession, d: str) -> DataFrame:
    """True ranks 1..n of each job: the model's by the canonical order, and competition ranks by the grade of the newest review."""
    c, grades = table(spark, d, "candidates"), A.relevance(table(spark, d, "candidates"), table(spark, d, "reviews").distinct()).where("score is not null")
    placed = positions(grades, "job_id", [F.desc("score"), F.asc_nulls_last("at"), F.col("id")], "model")
    n = placed.groupBy("job_id").agg(*[F.count_if(F.col("rel") > g).alias(f"above{g}") for g in (0, 1, 2)])
    judged = F.when(F.col("rel") == 2, F.col("above2")).when(F.col("rel") == 1, F.col("above1")).otherwise(F.col("above0")) + 1
    kinds = c.select("id", "file_type").distinct()
    return placed.join(n, "job_id").join(kinds, "id").select("job_id", "id", "file_type", "model", judged.alias("judged"))


_RANKS = f"""WITH {CAND}, {REV}, g0 AS (SELECT cand.id, job_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY score DESC, "cand"."at" ASC NULLS LAST, cand.id) AS BIGINT) model, CASE decision WHEN 'advance' THEN 2 WHEN 'needs_info' THEN 1 ELSE 0 END rel
FROM cand LEFT JOIN lastc ON cand.id = lastc.candidate_id WHERE job_id IS NOT NULL AND score IS NOT NULL), g AS (SELECT id, job_id, model, CAST(rank() OVER (PARTITION BY job_id ORDER BY rel DESC) AS BIGINT) judged FROM g0)"""
_TAU = """, cd AS (SELECT a.job_id, sum(CASE WHEN b.judged < a.judged THEN 1 ELSE 0 END) c, sum(CASE WHEN b.judged > a.judged THEN 1 ELSE 0 END) d FROM g a JOIN g b ON a.job_id = b.job_id AND b.model < a.model GROUP BY 1),
tt AS (SELECT job_id, count(*)::DOUBLE n FROM g GROUP BY 1), tr AS (SELECT job_id, sum(x * (x - 1) / 2) v FROM (SELECT job_id, judged, count(*)::DOUBLE x FROM g GROUP BY ALL) GROUP BY 1),
tau AS (SELECT tt.job_id, CAST(n AS BIGINT) n, CASE WHEN (n * (n - 1) / 2) * (n * (n - 1) / 2 - tr.v) > 0 THEN (coalesce(c, 0) - coalesce(d, 0)) / sqrt((n * (n - 1) / 2) * (n * (n - 1) / 2 - tr.v)) END tau FROM tt JOIN tr USING (job_id) LEFT JOIN cd USING (job_id)),
rk AS (SELECT *, count(*) OVER (PARTITION BY job_id) n, model <= 5 m, judged <= 5 j FROM g),
tk AS (SELECT job_id, max(n) n, CASE WHEN max(n) >= 5 THEN CAST(count(*) FILTER (m AND j) AS DOUBLE) / count(*) FILTER (m) END "precision", CASE WHEN max(n) >= 5 THEN CAST(count(*) FILTER (m AND j) AS DOUBLE) / count(*) FILTER (j) END recall FROM rk GROUP BY 1)"""


@query("kendall_tau", _RANKS + _TAU + " SELECT job_id, n, round(tau, 9) tau FROM tau")
def kendall_tau(spark: SparkSession, d: str) -> DataFrame:
    return E.kendall_tau_b(_ranks(spark, d), "job_id", "id", "model", "judged").withColumn("tau", F.round("tau", 9))


@query("top_k_overlap", _RANKS + _TAU + ' SELECT job_id, n, "precision", recall FROM tk')
def top_k_overlap(spark: SparkSession, d: str) -> DataFrame:
    return E.top_k_overlap(_ranks(spark, d), "job_id", "id", "model", "judged")


@query("competition_ranks", _RANKS + ' SELECT DISTINCT job_id, true "valid" FROM g')
def competition_ranks(spark: SparkSession, d: str) -> DataFrame:
    return E.competition_ranks_valid(_ranks(spark, d), "job_id", "judged")


@query("ranking_macro", _RANKS + _TAU + """ SELECT CAST(NULL AS VARCHAR) field, CAST(NULL AS VARCHAR) "value", true reported, count(*) "groups", CAST(sum(tau.n) AS BIGINT) items, round(avg(tau), 9) tau, round(avg("precision"), 9) "precision", round(avg(recall), 9) recall FROM tau JOIN tk USING (job_id) WHERE tau.n > 1""")
def ranking_macro(spark: SparkSession, d: str) -> DataFrame:
    """Tau and overlap averaged over the jobs, each with equal weight."""
    return E.ranking_report(_ranks(spark, d), "job_id", "id", "model", "judged").select("field", "value", "reported", "groups", "items", *[F.round(c, 9).alias(c) for c in ("tau", "precision", "recall")])


@query("blind_labels", f"""WITH {CAND} SELECT job_id, id, chr(CAST(65 + (row_number() OVER (PARTITION BY job_id ORDER BY score DESC NULLS LAST, "at" ASC NULLS LAST, id) - 1) % 26 AS INT)) blind_label FROM cand""")
def blind_labels(spark: SparkSession, d: str) -> DataFrame:
    c = A.scored(table(spark, d, "candidates"))
    return E.blind_labels(c, "job_id", [F.desc_nulls_last("score"), F.asc_nulls_last("at"), F.col("id")]).select("job_id", "id", "blind_label")


# ---- scorecards

_CARDS = f"""cards AS (SELECT DISTINCT id, candidate_id, {ROLE} "role", overall_recommendation FROM interview_scorecards),
sc AS (SELECT s.id, s.scorecard_id, c.candidate_id, c."role", s.criterion_id, s.score FROM (SELECT DISTINCT id, scorecard_id, criterion_id, score FROM interview_criterion_scores WHERE score BETWEEN 1 AND 5) s JOIN cards c ON s.scorecard_id = c.id)"""


@query("interview_summary", f"""WITH {_CARDS} SELECT candidate_id, "role", criterion_id, CAST(grouping_id(candidate_id, "role", criterion_id) AS BIGINT) "grouping", CAST(sum(score) AS DOUBLE) / count(*) mean, count(*) n FROM sc WHERE candidate_id IS NOT NULL
GROUP BY GROUPING SETS ((candidate_id), (candidate_id, "role"), (candidate_id, criterion_id), (candidate_id, "role", criterion_id))""")
def interview_summary(spark: SparkSession, d: str) -> DataFrame:
    return S.interview_summary(table(spark, d, "interview_scorecards"), table(spark, d, "interview_criterion_scores"))


@query("card_averages", f"WITH {_CARDS} SELECT DISTINCT i.id scorecard_id, i.candidate_id, mean, coalesce(n, 0) n FROM interview_scorecards i LEFT JOIN (SELECT scorecard_id, CAST(sum(score) AS DOUBLE) / count(*) mean, count(*) n FROM sc GROUP BY 1) m ON i.id = m.scorecard_id")
def card_averages(spark: SparkSession, d: str) -> DataFrame:
    return S.card_averages(table(spark, d, "interview_scorecards"), table(spark, d, "interview_criterion_scores"))


@query("role_delta", f"""WITH {_CARDS}, m AS (SELECT candidate_id, CAST(sum(score) FILTER ("role" = 'recruiter') AS DOUBLE) / nullif(count(*) FILTER ("role" = 'recruiter'), 0) recruiter, CAST(sum(score) FILTER ("role" = 'hiring_manager') AS DOUBLE) / nullif(count(*) FILTER ("role" = 'hiring_manager'), 0) hiring_manager FROM sc GROUP BY 1)
SELECT *, abs(recruiter - hiring_manager) delta, CAST(sign(recruiter - hiring_manager) AS INT) sign FROM m WHERE recruiter IS NOT NULL AND hiring_manager IS NOT NULL""")
def role_delta(spark: SparkSession, d: str) -> DataFrame:
    return S.role_delta(table(spark, d, "interview_scorecards"), table(spark, d, "interview_criterion_scores"))


@query("nested_cards", "SELECT c.id, coalesce(n, 0) n, f first_criterion FROM (SELECT DISTINCT id FROM interview_scorecards) c LEFT JOIN (SELECT scorecard_id, count(*) n, first(criterion_id ORDER BY id) f FROM (SELECT DISTINCT id, scorecard_id, criterion_id FROM interview_criterion_scores) GROUP BY 1) s ON s.scorecard_id = c.id")
def nested_cards(spark: SparkSession, d: str) -> DataFrame:
    """Every scorecard with its scores: their number and the first criterion."""
    cards = S.nested_cards(table(spark, d, "interview_scorecards").distinct(), table(spark, d, "interview_criterion_scores"))
    return cards.select("id", F.greatest(F.coalesce(F.size("scores"), F.lit(0)), F.lit(0)).cast("bigint").alias("n"), F.try_element_at("scores", F.lit(1))["criterion_id"].alias("first_criterion"))


@query("interview_profile", f"""WITH c AS (SELECT DISTINCT id, candidate_id, reviewer, overall_recommendation r, {AT.format('created_at')} a FROM interview_scorecards)
SELECT candidate_id, string_agg(r, ' | ' ORDER BY a ASC NULLS FIRST, id) FILTER (r <> '') recommendations, count(*) n_cards, count(DISTINCT reviewer) n_reviewers FROM c GROUP BY 1""")
def interview_profile(spark: SparkSession, d: str) -> DataFrame:
    """Reviewers and recommendations of every interviewed candidate, in order."""
    p = S.interview_profile(table(spark, d, "interview_scorecards"), table(spark, d, "interview_criterion_scores"))
    return p.select("candidate_id", F.nullif(F.array_join("recommendations", " | "), F.lit("")).alias("recommendations"), F.col("n_cards").cast("bigint").alias("n_cards"), F.size(F.array_compact("reviewers")).cast("bigint").alias("n_reviewers"))


# ---- annotations

_CLEAN = "regexp_replace(lower(trim({0})), '[ _-]+', '_', 'g')"
_ANN = f"""ann AS (SELECT DISTINCT *, {_CLEAN.format('recruiter_label')} rl, {_CLEAN.format('hiring_manager_label')} hl, {_CLEAN.format('adjudicated_label')} al,
 CASE model_result WHEN 'matched' THEN 'supported' WHEN 'partial' THEN 'partial' WHEN 'unknown' THEN 'no_evidence' WHEN 'needs_verification' THEN 'needs_verification' END ml FROM annotations)"""
_LABELS = ("supported", "partial", "no_evidence", "needs_verification")
_IN = "IN ('supported', 'partial', 'no_evidence', 'needs_verification')"


def _annotations(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "annotations").distinct()
    clean = lambda c: F.regexp_replace(F.lower(F.trim(c)), "[ _-]+", "_")
    known = lambda c: F.when(clean(c).isin(*_LABELS), clean(c))
    m = F.col("model_result")
    model = F.when(m == "matched", "supported").when(m.isin("partial", "needs_verification"), m).when(m == "unknown", "no_evidence")
    return a.select("*", known("recruiter_label").alias("rl"), known("hiring_manager_label").alias("hl"), known("adjudicated_label").alias("al"), model.alias("ml"))


@query(
    "annotation_kappa",
    f"WITH {_ANN}, pairs AS (SELECT job_family, rl l, hl r FROM ann WHERE rl {_IN} AND hl {_IN})"
    + _KAPPA.format(keys="job_family,", akeys="job_family,", ukeys="job_family,")
    + """ SELECT job_family, CAST(n AS BIGINT) n, CAST(coalesce(same, 0) AS DOUBLE) / n observed, CAST(coalesce(ab, 0) AS DOUBLE) / (CAST(n AS DOUBLE) * n) expected,
  CASE WHEN coalesce(ab, 0) < n * n THEN round((CAST(coalesce(same, 0) AS DOUBLE) / n - CAST(coalesce(ab, 0) AS DOUBLE) / (CAST(n AS DOUBLE) * n)) / (1.0 - CAST(coalesce(ab, 0) AS DOUBLE) / (CAST(n AS DOUBLE) * n)), 9) END kappa FROM tot LEFT JOIN pe USING (job_family)""",
)
def annotation_kappa(spark: SparkSession, d: str) -> DataFrame:
    return A.cohen_kappa(_annotations(spark, d), "rl", "hl", ["job_family"], degenerate="null").withColumn("kappa", F.round("kappa", 9))


@query("model_confusion", f"WITH {_ANN} SELECT al actual, ml predicted, count(*) n FROM ann WHERE al {_IN} AND ml IS NOT NULL GROUP BY ALL")
def model_confusion(spark: SparkSession, d: str) -> DataFrame:
    return E.confusion(_annotations(spark, d), "al", "ml")


@query("model_metrics", f"""WITH {_ANN}, c AS (SELECT al actual, ml predicted, count(*) n FROM ann WHERE al {_IN} AND ml IS NOT NULL GROUP BY ALL), l AS (SELECT actual label FROM c UNION SELECT predicted FROM c),
m AS (SELECT label, coalesce((SELECT sum(n) FROM c WHERE actual = label), 0) s, coalesce((SELECT sum(n) FROM c WHERE predicted = label), 0) p, coalesce((SELECT sum(n) FROM c WHERE predicted = label AND actual = label), 0) t FROM l)
SELECT label, CAST(s AS BIGINT) support, CAST(t AS DOUBLE) / nullif(p, 0) "precision", CAST(t AS DOUBLE) / nullif(s, 0) recall, CAST(2 * t AS DOUBLE) / nullif(p + s, 0) f1 FROM m""")
def model_metrics(spark: SparkSession, d: str) -> DataFrame:
    return E.label_metrics(E.confusion(_annotations(spark, d), "al", "ml"))


def _strata_sql(order: str) -> str:
    return f"""WITH {_ANN}, u AS (SELECT candidate_id, rl = hl same, unnest([{{'f': 'job_family', 'v': job_family}}, {{'f': 'source_format', 'v': source_format}}, {{'f': 'criterion_id', 'v': criterion_id}}, {{'f': 'cv_language', 'v': cv_language}}], recursive := true) FROM ann),
g AS (SELECT f field, v "value", count(DISTINCT candidate_id) candidates, count(*) n, count(*) FILTER (same) agree FROM u GROUP BY ALL), h AS (SELECT *, count(*) FILTER (candidates < 5) OVER (PARTITION BY field) hid, row_number() OVER (PARTITION BY field, candidates >= 5 ORDER BY candidates {order}, "value" DESC NULLS LAST) p FROM g),
s AS (SELECT *, candidates >= 5 AND NOT (hid = 1 AND p = 1) reported FROM h) SELECT field, "value", reported, CASE WHEN reported THEN candidates END candidates, CASE WHEN reported THEN n END n, CASE WHEN reported THEN agree END agree FROM s"""


def _strata(spark: SparkSession, d: str, hide: str) -> DataFrame:
    m = {"n": F.count(F.lit(1)), "agree": F.count_if(F.col("rl") == F.col("hl"))}
    return E.stratified(_annotations(spark, d), ["criterion_id", "job_family", "cv_language", "source_format"], "candidate_id", m, hide=hide)


@query("strata_hide_smallest", _strata_sql("ASC").replace("rl = hl same", f"rl {_IN} AND rl = hl same"))
def strata_hide_smallest(spark: SparkSession, d: str) -> DataFrame:
    return _strata(spark, d, "smallest")


@query("strata_hide_largest", _strata_sql("DESC").replace("rl = hl same", f"rl {_IN} AND rl = hl same"))
def strata_hide_largest(spark: SparkSession, d: str) -> DataFrame:
    return _strata(spark, d, "largest")


@query("locator_report", f"""WITH {_ANN}, x AS (SELECT count(*) FILTER (model_result IN ('matched', 'partial', 'needs_verification')) expected, count(*) FILTER (model_result IN ('matched', 'partial', 'needs_verification') AND (trim(coalesce(model_evidence_ref, '')) <> '' OR trim(coalesce(model_evidence_page, '')) <> '')) present FROM ann)
SELECT expected, present, expected - present missing, CAST(present AS DOUBLE) / nullif(expected, 0) rate FROM x""")
def locator_report(spark: SparkSession, d: str) -> DataFrame:
    return E.locator_report(_annotations(spark, d))


@query("citation_report", f"""WITH {_ANN}, x AS (SELECT count(*) FILTER (lower(trim(adjudicated_reference_label)) = 'valid') "valid", count(*) FILTER (lower(trim(adjudicated_reference_label)) = 'incorrect') incorrect, count(*) FILTER (lower(trim(adjudicated_reference_label)) = 'missing') missing FROM ann WHERE model_result IN ('matched', 'partial', 'needs_verification'))
SELECT *, CAST("valid" AS DOUBLE) / nullif("valid" + incorrect, 0) validity, CAST("valid" AS DOUBLE) / nullif("valid" + incorrect + missing, 0) coverage FROM x""")
def citation_report(spark: SparkSession, d: str) -> DataFrame:
    return E.citation_report(_annotations(spark, d))


@query("locator_violations", f"""WITH {_ANN}, x AS (SELECT candidate_id, criterion_id, CASE WHEN lower(trim(adjudicated_reference_label)) IN ('valid', 'incorrect') AND trim(coalesce(model_evidence_ref, '')) = '' THEN 'cited_without_reference'
 WHEN lower(trim(adjudicated_reference_label)) = 'missing' AND trim(coalesce(model_evidence_ref, '')) <> '' THEN 'missing_with_reference' WHEN lower(trim(adjudicated_reference_label)) = 'not_applicable' AND model_result IN ('matched', 'partial') THEN 'positive_not_applicable' END violation FROM ann)
SELECT * FROM x WHERE violation IS NOT NULL""")
def locator_violations(spark: SparkSession, d: str) -> DataFrame:
    return E.locator_violations(_annotations(spark, d)).select("candidate_id", "criterion_id", "violation")


@query("roster_check", """SELECT coalesce(a.candidate_id, b.candidate_id) candidate_id, coalesce(a.criterion_id, b.criterion_id) criterion_id, CASE WHEN b.candidate_id IS NULL THEN 'master' ELSE 'packet' END side
FROM (SELECT DISTINCT candidate_id, criterion_id FROM annotations) a FULL JOIN (SELECT DISTINCT candidate_id, criterion_id FROM annotation_packets WHERE reviewer_role = 'recruiter') b ON a.candidate_id = b.candidate_id AND a.criterion_id = b.criterion_id WHERE a.candidate_id IS NULL OR b.candidate_id IS NULL""")
def roster_check(spark: SparkSession, d: str) -> DataFrame:
    return E.roster_difference(table(spark, d, "annotations"), table(spark, d, "annotation_packets").where("reviewer_role = 'recruiter'"), ["candidate_id", "criterion_id"])


_NEWEST = "SELECT candidate_id, criterion_id, reviewer_label, reference_label FROM (SELECT DISTINCT * FROM annotation_packets WHERE reviewer_role = '{0}') QUALIFY row_number() OVER (PARTITION BY candidate_id, criterion_id ORDER BY labelled_at DESC NULLS LAST, annotator DESC NULLS LAST, reviewer_label DESC NULLS LAST, reference_label DESC NULLS LAST) = 1"


@query("packets_merged", f"""SELECT m.*, r.reviewer_label recruiter_label, r.reference_label recruiter_reference_label, h.reviewer_label hiring_manager_label, h.reference_label hiring_manager_reference_label
FROM (SELECT DISTINCT candidate_id, criterion_id, model_result FROM annotations) m JOIN ({_NEWEST.format('recruiter')}) r USING (candidate_id, criterion_id) JOIN ({_NEWEST.format('hiring_manager')}) h USING (candidate_id, criterion_id)""")
def packets_merged(spark: SparkSession, d: str) -> DataFrame:
    """Items that both roles labelled, each with the newest label of either."""
    p = table(spark, d, "annotation_packets").distinct()
    keys, values = ["candidate_id", "criterion_id"], ["reviewer_label", "reference_label"]
    master = table(spark, d, "annotations").select(*keys, "model_result").distinct()
    one = lambda role: K.newest_labels(p.where(F.col("reviewer_role") == role), keys, values)
    return K.merge_packets(master, one("recruiter"), one("hiring_manager"), keys)


@query("form_violations", "SELECT candidate_id, criterion_id, unnest(v) field FROM (SELECT candidate_id, criterion_id, list_filter([" + ", ".join(f"CASE WHEN NOT coalesce(regexp_matches(trim({c}), '{f}'), false) THEN '{c}' END" for c, f in K.FORMS.items()) + "], lambda x: x IS NOT NULL) v FROM (SELECT DISTINCT * FROM annotations))")
def form_violations(spark: SparkSession, d: str) -> DataFrame:
    """Annotation rows and the columns whose form they break."""
    return K.form_violations(table(spark, d, "annotations").distinct()).select("candidate_id", "criterion_id", F.explode("violations").alias("field"))


@query("agreement_report", f"""WITH {_ANN}, x AS (SELECT candidate_id, rl = hl same FROM ann WHERE rl {_IN} AND hl {_IN}), c AS (SELECT count(*) n, count(*) FILTER (same) e, count(DISTINCT candidate_id) FILTER (same) a, count(DISTINCT candidate_id) FILTER (NOT same) b FROM x)
SELECT n "rows", NOT ((a BETWEEN 1 AND 4) OR (b BETWEEN 1 AND 4)) AND n > 0 reported, CASE WHEN NOT ((a BETWEEN 1 AND 4) OR (b BETWEEN 1 AND 4)) THEN e END exact, CASE WHEN NOT ((a BETWEEN 1 AND 4) OR (b BETWEEN 1 AND 4)) THEN round(e / n, 9) END rate FROM c""")
def agreement_report(spark: SparkSession, d: str) -> DataFrame:
    a = E.agreement_metrics(_annotations(spark, d), "rl", "hl", "candidate_id")
    return a.select("rows", "reported", "exact", F.round("rate", 9).alias("rate"))


@query("model_report", f"""WITH {_ANN}, x AS (SELECT candidate_id, al, ml FROM ann WHERE al {_IN} AND ml IS NOT NULL), p AS (SELECT count(DISTINCT candidate_id) FILTER (al = ml) a, count(DISTINCT candidate_id) FILTER (al <> ml) b, count(*) n, count(*) FILTER (al = ml) t FROM x)
SELECT label, (SELECT count(*) FROM x WHERE al = label) support, round((SELECT CASE WHEN n > 0 AND a NOT BETWEEN 1 AND 4 AND b NOT BETWEEN 1 AND 4 THEN t / n END FROM p), 9) accuracy FROM (SELECT unnest(['supported', 'partial', 'no_evidence', 'needs_verification']) label) WHERE (SELECT count(DISTINCT candidate_id) FROM x WHERE al = label) >= 5""")
def model_report(spark: SparkSession, d: str) -> DataFrame:
    """Support of the reported labels, and the accuracy."""
    m = E.model_report(_annotations(spark, d), "al", "ml", "candidate_id", _LABELS)
    return m.where("reported").select("label", F.col("support").cast("bigint").alias("support"), F.round("accuracy", 9).alias("accuracy"))


_OVER = [f"CASE WHEN regexp_matches(lower(coalesce(txt, '')), '(^|[^\\w]){w}([^\\w]|$)') THEN '{w}' END" for w in ("python", "docker", "kafka", "linux", "terraform", "jira")]
_HELD = [f"CASE WHEN regexp_matches(lower(coalesce(profile_json, '')), '\"{w}\"') THEN '{w}' END" for w in ("python", "docker", "kafka", "linux", "terraform", "jira")]


@query("skill_overlap", f"""WITH s AS (SELECT candidate_id, string_agg(snippet, chr(10)) txt FROM (SELECT DISTINCT id, candidate_id, snippet FROM evidence) GROUP BY 1), c AS (SELECT DISTINCT id, profile_json FROM candidates),
x AS (SELECT list_filter([{', '.join(_OVER)}], lambda v: v IS NOT NULL) p, list_filter([{', '.join(_HELD)}], lambda v: v IS NOT NULL) e FROM c LEFT JOIN s ON s.candidate_id = c.id),
t AS (SELECT sum(length(list_intersect(p, e))) tp, sum(length(p)) np, sum(length(e)) ne FROM x) SELECT CAST(tp AS DOUBLE) / nullif(np, 0) "precision", CAST(tp AS DOUBLE) / nullif(ne, 0) recall, CAST(2 * tp AS DOUBLE) / nullif(np + ne, 0) f1, CAST(tp AS BIGINT) tp, CAST(np AS BIGINT) np, CAST(ne AS BIGINT) ne FROM t""")
def skill_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Skills that the snippets of a candidate name against those that the profile lists: micro precision, recall and F1."""
    names = ("python", "docker", "kafka", "linux", "terraform", "jira")
    e = table(spark, d, "evidence").select("id", "candidate_id", "snippet").distinct()
    found = e.select(F.col("candidate_id").alias("id"), F.explode(T.skills(F.col("snippet"), names)).alias("s")).groupBy("id").agg(F.collect_set("s").alias("p"))  # at most the names
    held = F.array_compact(F.array(*[F.when(F.contains(F.lower("profile_json"), F.lit(f'"{n}"')), F.lit(n)) for n in names]))
    c = table(spark, d, "candidates").select("id", "profile_json").distinct().select("id", held.alias("e"))
    return E.overlap(c.join(found, "id", "left"), "p", "e")


@query("role_keys", "WITH j AS (SELECT DISTINCT id, trim(regexp_replace(lower(coalesce(title, '')), '[^\\p{L}\\p{N}_]+', ' ', 'g')) t, trim(regexp_replace(lower(coalesce(department, '')), '[^\\p{L}\\p{N}_]+', ' ', 'g')) d FROM jobs) SELECT id job_id, CASE "
  + " ".join("WHEN " + " OR ".join(f"contains({'t' if r.title_only else chr(116) + ' || chr(32) || d'}, '{w}')" for w in r.words) + f" THEN '{r.key}'" for r in O.ROLES) + " ELSE 'general' END \"role\" FROM j")
def role_keys(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "jobs").select("id", "title", "department").distinct()
    return j.select(F.col("id").alias("job_id"), O.role_key(F.col("title"), F.col("department")).alias("role"))


@query("most_common_skills", "WITH t AS (SELECT doc_id, lower(text) l FROM documents WHERE text IS NOT NULL), s AS (SELECT unnest([" + ", ".join(f"'{s}'" for s in SKILLS) + r"]) skill) SELECT skill, count(*) n, min(doc_id) first_seen FROM t, s WHERE regexp_matches(l, '(^|[^\w])' || regexp_replace(skill, '([.+#])', '\\\1', 'g') || '([^\w]|$)') GROUP BY 1 ORDER BY n DESC, first_seen LIMIT 10")
def most_common_skills(spark: SparkSession, d: str) -> DataFrame:
    """The ten most named skills; equal numbers by the first document that names them."""
    s = _texts(spark, d).select("doc_id", F.explode(T.skills(F.col("text"), SKILLS)).alias("skill"))
    return s.groupBy("skill").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_seen")).orderBy(F.desc("n"), "first_seen").limit(10)


@query("skills_by_source", "WITH t AS (SELECT source, lower(text) l FROM documents WHERE text IS NOT NULL), s AS (SELECT unnest([" + ", ".join(f"'{s}'" for s in SKILLS) + r"]) skill) SELECT source, skill, count(*) n FROM t, s WHERE regexp_matches(l, '(^|[^\w])' || regexp_replace(skill, '([.+#])', '\\\1', 'g') || '([^\w]|$)') GROUP BY ALL")
def skills_by_source(spark: SparkSession, d: str) -> DataFrame:
    s = spread(table(spark, d, "documents").select("source", "text")).select("source", F.explode(T.skills(F.col("text"), SKILLS)).alias("skill"))
    return s.groupBy("source", "skill").agg(F.count(F.lit(1)).alias("n"))


# ---- audit and time


@query("audit_newest", f"SELECT * FROM (SELECT DISTINCT id, event_type, epoch_us({AT.format('created_at')}) us FROM audit_events) ORDER BY us DESC NULLS LAST, id LIMIT 100")
def audit_newest(spark: SparkSession, d: str) -> DataFrame:
    """The newest hundred audit events."""
    a = table(spark, d, "audit_events").select("id", "event_type", F.unix_micros(instant(F.col("created_at"))).alias("us")).distinct()
    return a.orderBy(F.desc_nulls_last("us"), "id").limit(100)


@query("audit_daily", f"SELECT event_type, strftime(date_trunc('day', {AT.format('created_at')} AT TIME ZONE 'UTC'), '%Y-%m-%d') AS \"day\", count(*) n FROM (SELECT DISTINCT id, event_type, created_at FROM audit_events) GROUP BY ALL")
def audit_daily(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "audit_events").select("id", "event_type", instant(F.col("created_at")).alias("at")).distinct()
    return a.groupBy("event_type", F.date_format("at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("rolling_limit", "SELECT event_id, n_window, n_window <= 6 AS \"within\" FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) n_window FROM events)")
def rolling_limit(spark: SparkSession, d: str) -> DataFrame:
    """Events of each user in the hour up to each event, and whether that is within the limit."""
    return A.rolling_limit(table(spark, d, "events"), "user_id", "ts", 3600, 6).select("event_id", "n_window", "within")


@query("approval_seals", f"""SELECT DISTINCT id, 'SEAL-' || upper(substr(h, 1, 4)) || '-' || upper(substr(h, 5, 4)) || '-' || upper(substr(h, 9, 4)) seal FROM (SELECT id, sha256(concat_ws(':', candidate_id, reviewer, role, created_at)) h FROM reviews)""")
def approval_seals(spark: SparkSession, d: str) -> DataFrame:
    cols = [F.col(c) for c in ("candidate_id", "reviewer", "role", "created_at")]
    return table(spark, d, "reviews").select("id", T.seal(*cols).alias("seal")).distinct()


@query("approval_gate", """WITH a AS (SELECT DISTINCT id, job_id, lower(trim(actor)) actor, json_extract_string(CASE WHEN json_valid(details_json) THEN details_json END, '$.role') "role" FROM audit_events WHERE event_type = 'criteria_approval_recorded')
SELECT job_id, count(DISTINCT "role") n_roles, count(DISTINCT actor) n_people, count(DISTINCT "role") >= 2 AND count(DISTINCT actor) >= 2 approved FROM a GROUP BY 1""")
def approval_gate(spark: SparkSession, d: str) -> DataFrame:
    """Jobs whose criteria two roles and two people approved."""
    a = table(spark, d, "audit_events").where("event_type = 'criteria_approval_recorded'").select("id", "job_id", F.lower(F.trim("actor")).alias("actor"), F.variant_get(F.try_parse_json("details_json"), "$.role", "string").alias("role")).distinct()
    n, m = F.countDistinct("role"), F.countDistinct("actor")
    return a.groupBy("job_id").agg(n.alias("n_roles"), m.alias("n_people"), ((n >= 2) & (m >= 2)).alias("approved"))


# ---- retrieval


QUESTIONS = (
    R.Query("q1", "budget review for the spring"), R.Query("q2", "Python services without manual restarts"), R.Query("q3", "incident handbook"), R.Query("q4", "dan yang the"),
    R.Query("q5", "kriteria wajib Python"), R.Query("q6", "panduan wawancara cloud"),
)
GUIDES = (("Ask every candidate the same questions and score them by the same rubric.", "Structured interview", 1.3), ("Score what the candidate did and what came of it, panduan wawancara STAR.", "Evidence", 1.3), ("The scale runs from 1 (no evidence) to 5 (mastery).", "Scale", 1.4))
RUBRICS = (("python", "Rubric: services, tests and packaging in Python."), ("cloud", "Rubric: cost, failure and access in the cloud."), (None, "Rubric ({}): a real situation, the candidate's own part and the measured result."))
TECHNICAL = ("python", "cloud", "sql", "docker")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    from corvane.operators.nested import child_table, flatten_json
    from corvane.plans.records import CRITERIA

    jobs = table(spark, d, "jobs")
    criteria = child_table(flatten_json(jobs, "criteria_json"), CRITERIA, {"label": "string", "type": "string", "weight": "double"}).select(F.col("row_id").alias("job_id"), "position", "label", "type", "weight")
    guides = spark.createDataFrame([(i, *g) for i, g in enumerate(GUIDES)], "no int, text string, label string, source_weight double")
    rubrics = spark.createDataFrame([(i, *r) for i, r in enumerate(RUBRICS)], "no int, keyword string, text string")
    return R.job_chunks(jobs, criteria, guides, rubrics)


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_WS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _norm(c: str) -> str:
    return f"trim(regexp_replace(replace(replace(replace(lower({c}), '–', '-'), '—', '-'), 'ß', 'ss'), '{_WS}', ' ', 'g'))"


def _tokens(c: str) -> str:
    stop = ", ".join(map(_quote, T.STOP_WORDS))
    clean = f"list_transform(regexp_extract_all({c}, '[a-z0-9+#./-]+'), lambda x: regexp_replace(x, '^[/-]+|[./-]+$', '', 'g'))"
    return f"list_filter({clean}, lambda x: (length(x) > 1 OR regexp_matches(x, '^[cr0-9]$')) AND NOT list_contains([{stop}], x))"


def _sentences(c: str) -> str:
    parts = rf"regexp_split_to_array(regexp_replace({c}, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+|[•\-*]\s+')"
    return f"list_filter(list_transform({parts}, lambda x: trim(regexp_replace(x, '{_WS}', ' ', 'g'))), lambda x: length(x) >= 5)"


_DESCRIBED = f"""chunks AS (SELECT id, CAST(i - 1 AS INT) chunk_no, s "text" FROM (SELECT id, unnest(ss) s, generate_subscripts(ss, 1) i FROM (SELECT id, {_sentences('description')} ss FROM (SELECT DISTINCT id, description FROM jobs WHERE description IS NOT NULL)))),
tok AS (SELECT id, chunk_no, {_tokens(_norm('"text"'))} tokens FROM chunks)"""
_ASKED = "q AS (SELECT * FROM (VALUES " + ", ".join(f"({_quote(q.id)}, {_quote(q.normal)}, [{', '.join(map(_quote, q.tokens))}]::VARCHAR[], {_quote(q.intent)})" for q in QUESTIONS) + ") v(query_id, normal, toks, intent))"
_RETRIEVED = rf"""WITH {_CRIT}, j AS (SELECT DISTINCT id job_id, trim(coalesce(title, '')) title, trim(coalesce(department, '')) department, trim(coalesce(description, '')) description FROM jobs),
c AS (SELECT *, coalesce(w, CASE WHEN req THEN 2.0 ELSE 1.0 END) weight FROM (SELECT DISTINCT job_id, i, trim("label") "label", lower(coalesce("type", 'required')) = 'required' req, w FROM crit) WHERE "label" <> ''),
g AS (SELECT * FROM (VALUES {', '.join(f"({i}, {_quote(a)}, {_quote(b)}, {w})" for i, (a, b, w) in enumerate(GUIDES))}) v("no", "text", "label", w)),
ru AS (SELECT * FROM (VALUES {', '.join(f"({i}, {_quote(a) if a else 'NULL'}, {_quote(b)})" for i, (a, b) in enumerate(RUBRICS))}) v("no", keyword, "text")),
ch AS (SELECT job_id, 0 a, 0 b, 'position_meta' source_type, title "label", 'Position: ' || title || CASE WHEN department <> '' THEN ' | Department: ' || department ELSE '' END "text", 1.2 sw FROM j WHERE title <> ''
 UNION ALL SELECT job_id, 1, i, 'job_description', 'Job Description', s, 1.1 FROM (SELECT job_id, unnest(ss) s, generate_subscripts(ss, 1) i FROM (SELECT job_id, {_sentences('description')} ss FROM j))
 UNION ALL SELECT job_id, 2, i, CASE WHEN req THEN 'required_criterion' ELSE 'preferred_criterion' END, "label", CASE WHEN req THEN 'required' ELSE 'preferred' END || ' criterion: ' || "label" || ' (weight ' || printf('%.1f', weight) || ')', weight * CASE WHEN req THEN 2.2 ELSE 1.1 END FROM c
 UNION ALL SELECT job_id, 3, "no", 'interview_rubric', "label", "text", w FROM j, g
 UNION ALL SELECT job_id, 4, i * 100 + "no", 'interview_rubric', "label", replace("text", '{{}}', "label"), CASE WHEN req THEN 1.6 ELSE 1.2 END FROM c, ru WHERE keyword IS NULL OR contains(lower("label"), keyword)),
pp AS (SELECT *, {_norm('"text"')} norm, {_norm('"label"')} tag FROM ch), tk AS (SELECT *, {_tokens('norm')} tokens FROM pp),
st AS (SELECT job_id, count(*) n, greatest(avg(length(tokens)), 1.0) m FROM tk GROUP BY 1), {_ASKED}, qt AS (SELECT query_id, unnest(list_distinct(toks)) term FROM q),
df AS (SELECT job_id, term, count(*) FILTER (list_contains(tokens, term)) df FROM tk, (SELECT DISTINCT term FROM qt) GROUP BY ALL),
e AS (SELECT tk.job_id, tk.a, tk.b, tk."text", qt.query_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) idf, term IN ({', '.join(map(_quote, TECHNICAL))}) tech, length(list_filter(tokens, lambda x: x = term)) tf0, contains(norm, term) sub, length(tokens) len, m, term = tag OR list_contains(string_split(tag, ' '), term) lab FROM tk JOIN st USING (job_id), qt JOIN df USING (term) WHERE df.job_id = tk.job_id),
f AS (SELECT *, CASE WHEN tf0 > 0 THEN tf0 WHEN sub THEN 1 ELSE 0 END tf, tf0 > 0 OR (length(term) >= 3 AND sub) hit FROM e),
h AS (SELECT job_id, a, b, "text", query_id, sum(idf * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * len / m)) * CASE WHEN tech THEN 2.0 ELSE 1.0 END) + 1.5 * count(*) FILTER (hit AND tech) base, count(*) FILTER (hit) matched, bool_or(lab) lab FROM f GROUP BY ALL),
s AS (SELECT h.*, tk.source_type, tk."label", round((base + CASE WHEN length(toks) < 2 THEN 0.0 WHEN contains(norm, array_to_string(toks, ' ')) THEN 4.0 * length(toks) WHEN contains(norm, normal) THEN 3.5 * length(toks) ELSE 1.8 * length(list_filter(range(1, length(toks)), lambda i: contains(norm, toks[i] || ' ' || toks[i + 1]))) END
 + CASE WHEN lab THEN 2.5 ELSE 0.0 END) * sw * CASE WHEN intent = tk.source_type THEN 1.8 ELSE 1.0 END, 4) score FROM h JOIN tk USING (job_id, a, b, "text") JOIN q USING (query_id) WHERE matched > 0),
d AS (SELECT * FROM s WHERE score > 0.01 QUALIFY row_number() OVER (PARTITION BY job_id, query_id, regexp_replace(lower("text"), '[^\p{{L}}\p{{N}}_]+', '', 'g') ORDER BY score DESC, a, b, "text") = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY job_id, query_id ORDER BY score DESC, a, b, "text") rank FROM d)
SELECT job_id, query_id, CAST(rank AS INT) "rank", source_type, "label", "text", score, matched FROM r WHERE rank <= 5"""


@query("bm25_topk", _RETRIEVED)
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five best chunks of every job for each question, from all its sources."""
    top = R.retrieve(_chunks(spark, d), QUESTIONS, TECHNICAL)
    return top.select("job_id", "query_id", "rank", "source_type", "label", "text", "score", F.size("matched").cast("bigint").alias("matched"))


def _described(spark: SparkSession, d: str) -> DataFrame:
    return R.sentence_chunks(table(spark, d, "jobs").select("id", "description").distinct(), "id", "description")


def _questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(q.id, q.text) for q in QUESTIONS], "query_id string, text string")


@query("index_bm25", f"""WITH {_DESCRIBED}, q AS (SELECT * FROM (VALUES {', '.join(f"({_quote(q.id)}, [{', '.join(map(_quote, q.tokens if set(q.tokens) - set(T.STOP_WORDS) else []))}]::VARCHAR[])" for q in QUESTIONS)}) v(query_id, toks)),
n AS (SELECT count(*) n, avg(length(tokens)) m FROM tok), qt AS (SELECT query_id, unnest(list_distinct(toks)) term FROM q), e AS (SELECT id, chunk_no, length(tokens) len, term, query_id, length(list_filter(tokens, lambda x: x = term)) tf FROM tok, qt),
df AS (SELECT term, count(DISTINCT (id, chunk_no)) df FROM e WHERE tf > 0 GROUP BY 1),
s AS (SELECT query_id, id, chunk_no, CAST(sum(CAST(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * len / m)) * CASE WHEN term = 'python' THEN 2.0 ELSE 1.0 END + CASE WHEN term = 'python' THEN 1.5 ELSE 0.0 END AS DECIMAL(24,12))) AS DOUBLE) score, count(*) matched FROM e JOIN df USING (term), n WHERE tf > 0 GROUP BY ALL)
SELECT query_id, id, chunk_no, round(score, 6) score, matched, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id, chunk_no) AS INT) "rank" FROM s QUALIFY "rank" <= 10""")
def index_bm25(spark: SparkSession, d: str) -> DataFrame:
    """The ten best sentences of all job descriptions for each question, by an inverted index."""
    chunks = _described(spark, d)
    stats = chunks.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(T.tokenize(F.col("text"), T.STOP_WORDS))).alias("m")).first()
    return R.bm25(R.postings(chunks, ["id", "chunk_no"]), _questions(spark), ["id", "chunk_no"], stats.n, stats.m or 1.0, ["python"]).withColumn("score", F.round("score", 6))


@query("idf_table", f"WITH {_DESCRIBED} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 9) idf FROM (SELECT term, count(*) df FROM (SELECT DISTINCT id, chunk_no, unnest(tokens) term FROM tok) GROUP BY 1), (SELECT count(*) n FROM tok)")
def idf_table(spark: SparkSession, d: str) -> DataFrame:
    chunks = _described(spark, d)
    return R.idf(R.postings(chunks, ["id", "chunk_no"]), chunks.count()).withColumn("idf", F.round("idf", 9))


@query("overlap_topk", f"""WITH {_DESCRIBED}, q AS (SELECT * FROM (VALUES {', '.join(f"({_quote(q.id)}, [{', '.join(map(_quote, q.tokens if set(q.tokens) - set(T.STOP_WORDS) else []))}]::VARCHAR[])" for q in QUESTIONS)}) v(query_id, toks))
SELECT query_id, id, chunk_no, CAST(n AS BIGINT) overlap, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n DESC, id, chunk_no) AS INT) "rank" FROM (SELECT query_id, id, chunk_no, length(list_intersect(tokens, toks)) n FROM tok, q) WHERE n > 0 QUALIFY "rank" <= 5""")
def overlap_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.overlap_rank(_described(spark, d), _questions(spark), ["id", "chunk_no"])


ORACLES["tokens_per_document"] = f"SELECT doc_id, CAST(length({_tokens(_norm('text'))}) AS INT) n_tokens, CAST(coalesce(length({_sentences('text')}), 0) AS INT) n_sentences FROM documents"
