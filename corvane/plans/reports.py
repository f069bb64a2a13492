"""Queries of exports, reports, feedback, dossiers and ingest, with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import reports as P
from corvane.operators.nested import child_table, flatten_json
from corvane.plans.analytics import AT, CAND, CRITERIA, EVID, REV, _CRIT, pct, query
from corvane.plans.records import CRITERIA as CRITERIA_KINDS
from corvane.session import spread, table


def _criteria(spark: SparkSession, d: str) -> DataFrame:
    nodes = child_table(flatten_json(table(spark, d, "jobs"), "criteria_json"), CRITERIA_KINDS, {"id": "string", "label": "string", "type": "string", "weight": "double"})
    return nodes.select(F.col("row_id").alias("job_id"), "position", "id", "label", "type", "weight").where("label is not null").distinct()


_STATED = _CRIT.replace("""o ->> '$.label' "label\"""", """o ->> '$.id' cid, o ->> '$.label' "label\"""") + """, stated AS (SELECT DISTINCT job_id, CAST(i AS INT) "position", cid, "label", lower(trim("label")) nm FROM crit WHERE "label" IS NOT NULL)"""
_LIST = """CASE WHEN json_type(j, '$.{0}') = 'ARRAY' THEN array_to_string(list_filter(list_transform(json_extract(j, '$.{0}[*]'), lambda x: coalesce(json_extract_string(x, '$.skill_name'), x ->> '$')), lambda x: x IS NOT NULL), ', ') WHEN json_type(j, '$.{0}') <> 'NULL' THEN json_extract_string(j, '$.{0}') END"""
_PROFILE = f"""prof AS (SELECT id, coalesce({_LIST.format('skills')}, '') skills, coalesce(json_extract_string(j, '$.experience_years_mentioned'), json_extract_string(j, '$.experience_years'), '') experience_years,
  coalesce({_LIST.format('education_levels_mentioned')}, {_LIST.format('education')}, '') education FROM (SELECT DISTINCT id, CASE WHEN json_valid(profile_json) THEN CAST(profile_json AS JSON) END j FROM candidates))"""
_NOTES = f"""notes AS (SELECT candidate_id, first(decision ORDER BY "at" DESC NULLS LAST, id DESC) decision, string_agg(note, ' | ' ORDER BY "at" DESC NULLS LAST, id DESC) FILTER (note <> '') notes FROM (SELECT DISTINCT id, candidate_id, decision, trim(note) note, {AT.format('created_at')} "at" FROM reviews) GROUP BY 1)"""


@query("candidates_csv", f"""WITH {_PROFILE}, {_NOTES}, c AS (SELECT DISTINCT id, job_id, file_type, CASE WHEN isnan(score) THEN NULL ELSE score END score, status, created_at FROM candidates)
SELECT c.id candidate_id, job_id, file_type, score, status, skills, experience_years, education, CASE WHEN n.candidate_id IS NOT NULL THEN coalesce(decision, '') WHEN coalesce(status, '') NOT IN ('', 'needs_review') THEN status ELSE '' END reviewer_decision, coalesce(notes, '') reviewer_notes, created_at
FROM c JOIN prof USING (id) LEFT JOIN notes n ON n.candidate_id = c.id""")
def candidates_csv(spark: SparkSession, d: str) -> DataFrame:
    return P.candidates_csv(table(spark, d, "candidates"), table(spark, d, "reviews"))


@query("evidence_csv", f"""WITH {CAND}, e AS (SELECT DISTINCT id, candidate_id, criterion, requirement_type, weight, result, confidence, snippet, page_number FROM evidence)
SELECT job_id, candidate_id, criterion, requirement_type, weight, result, confidence, snippet, coalesce(CAST(page_number AS VARCHAR), '') page_number FROM e JOIN cand ON e.candidate_id = cand.id""")
def evidence_csv(spark: SparkSession, d: str) -> DataFrame:
    return P.evidence_csv(table(spark, d, "evidence"), table(spark, d, "candidates")).drop("sort")


LABELS = {"needs_review": "to review", "advance": "goes on", "needs_info": "open", "not_selected": "not chosen"}
_WORDS = "CASE {0} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in LABELS.items()) + " ELSE {0} END"


@query("review_table", f"""WITH {CAND}, {REV}, {_PROFILE}, e AS (SELECT candidate_id, count(*) FILTER (result = 'matched') matched, count(*) FILTER (result = 'partial') "partial", count(*) FILTER (result = 'unknown') "unknown" FROM (SELECT DISTINCT id, candidate_id, result FROM evidence) GROUP BY 1),
f AS (SELECT DISTINCT id, upper(file_type) format, created_at FROM candidates), nt AS (SELECT candidate_id, first(trim(note) ORDER BY {AT.format('created_at')} DESC NULLS LAST, id DESC) note FROM reviews GROUP BY 1)
SELECT job_id, cand.id candidate_id, upper(right(cand.id, 4)) "label", CAST(round_even(score, 0) AS INT) score, {_WORDS.format('status')} status, format, coalesce(nullif(experience_years, ''), '-') experience_years, education, skills, coalesce(matched, 0) matched, coalesce("partial", 0) "partial", coalesce("unknown", 0) "unknown",
 coalesce(nullif(trim(reviewer), ''), '-') reviewer, coalesce(nullif(trim("role"), ''), '-') "role", {_WORDS.format("coalesce(nullif(trim(decision), ''), '-')")} decision, coalesce(note, '') note, created_at
FROM cand JOIN prof USING (id) JOIN f USING (id) LEFT JOIN e ON e.candidate_id = cand.id LEFT JOIN lastc ON lastc.candidate_id = cand.id LEFT JOIN nt ON nt.candidate_id = cand.id""")
def review_table(spark: SparkSession, d: str) -> DataFrame:
    return P.review_table(table(spark, d, "candidates"), table(spark, d, "evidence"), table(spark, d, "reviews").distinct(), LABELS)


@query("job_reports")
def job_reports(spark: SparkSession, d: str) -> DataFrame:
    """One nested JSON document per candidate; a job's are its report."""
    return P.candidate_reports(table(spark, d, "candidates"), table(spark, d, "evidence"), table(spark, d, "reviews"))


@query("report_headers", f"""WITH c AS (SELECT job_id, count(DISTINCT id) n FROM candidates GROUP BY 1), a AS (SELECT job_id, count(*) n, epoch_us(max({AT.format('created_at')})) us FROM (SELECT DISTINCT id, job_id, created_at FROM audit_events) GROUP BY 1)
SELECT j.id job_id, title, department, status, coalesce(c.n, 0) n_candidates, coalesce(a.n, 0) n_events, us last_event_us FROM (SELECT DISTINCT id, title, department, status FROM jobs) j LEFT JOIN c ON c.job_id = j.id LEFT JOIN a ON a.job_id = j.id""")
def report_headers(spark: SparkSession, d: str) -> DataFrame:
    return P.report_headers(table(spark, d, "jobs"), table(spark, d, "candidates"), table(spark, d, "audit_events"))


@query("audit_trail", f"SELECT DISTINCT job_id, epoch_us({AT.format('created_at')}) us, id, candidate_id, actor, event_type, details_json FROM audit_events")
def audit_trail(spark: SparkSession, d: str) -> DataFrame:
    return P.audit_trail(table(spark, d, "audit_events"))


@query("candidate_feedback", f"""WITH {CAND}, r AS (SELECT DISTINCT id, candidate_id, reviewer, role, trim(note) note, {AT.format('created_at')} "at" FROM reviews),
rv AS (SELECT candidate_id, string_agg(reviewer || CASE role WHEN 'recruiter' THEN ' (Recruiter)' WHEN 'hiring_manager' THEN ' (Hiring Manager)' ELSE coalesce(' (' || nullif(role, '') || ')', '') END, ', ' ORDER BY "at" DESC NULLS LAST, id DESC) FILTER (coalesce(reviewer, '') <> '') people, first(note ORDER BY "at" DESC NULLS LAST, id DESC) FILTER (note <> '') note FROM r GROUP BY 1),
e AS (SELECT candidate_id, count(*) FILTER (result IN ('matched', 'partial')) n_strengths, count(*) FILTER (result = 'unknown') n_growth, first(criterion ORDER BY weight DESC, criterion, id) FILTER (result IN ('matched', 'partial')) strongest FROM (SELECT DISTINCT id, candidate_id, criterion, weight, result FROM evidence) GROUP BY 1),
b AS (SELECT cand.id candidate_id, coalesce(nullif(trim(title), ''), 'Position') job_title, lower(status) st, coalesce(nullif(people, ''), 'the reviewers') people, note, coalesce(n_strengths, 0) n_strengths, coalesce(n_growth, 0) n_growth, strongest FROM cand LEFT JOIN (SELECT DISTINCT id, title FROM jobs) j ON j.id = cand.job_id LEFT JOIN rv ON rv.candidate_id = cand.id LEFT JOIN e ON e.candidate_id = cand.id)
SELECT candidate_id, job_title, n_strengths, n_growth, strongest, CASE st WHEN 'advance' THEN 'Goes on: ' || people || ' found the main criteria for ' || job_title || ' met.' WHEN 'needs_info' THEN 'Open: ' || people || ' ask for more about ' || job_title || '.' WHEN 'not_selected' THEN 'Not chosen for ' || job_title || ' by ' || people || '.' ELSE 'Waits for a review.' END || coalesce(' Note: ' || note, '') decision_summary FROM b""")
def candidate_feedback(spark: SparkSession, d: str) -> DataFrame:
    """Feedback of every candidate: how many strengths and growth areas, the strongest criterion and the summary."""
    f = P.candidate_feedback(table(spark, d, "candidates"), table(spark, d, "jobs"), table(spark, d, "evidence"), table(spark, d, "reviews"))
    return f.select("candidate_id", "job_title", F.size("strengths").cast("bigint").alias("n_strengths"), F.size("growth_areas").cast("bigint").alias("n_growth"), F.try_element_at("strengths", F.lit(1))["criterion"].alias("strongest"), "decision_summary")


@query("dossier_matrix", f"""WITH {_STATED}, {CAND}, rk AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY score DESC NULLS LAST, "at" ASC NULLS LAST, id) p, bool_or(status = 'advance') OVER (PARTITION BY job_id) adv FROM cand WHERE job_id IS NOT NULL),
ch AS (SELECT job_id, id candidate_id, score FROM rk WHERE status = 'advance' OR (NOT adv AND p <= 5)), e AS (SELECT DISTINCT candidate_id, criterion_id, lower(trim(criterion)) nm, id, result, snippet FROM evidence),
bi AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY candidate_id, criterion_id ORDER BY id) = 1), bn AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY candidate_id, nm ORDER BY id) = 1)
SELECT ch.job_id, ch.candidate_id, ch.score, s."position", s."label", CASE WHEN bi.id IS NOT NULL THEN bi.result WHEN bn.id IS NOT NULL THEN bn.result ELSE 'unknown' END result, coalesce(bi.snippet, bn.snippet, '') snippet
FROM ch JOIN stated s ON s.job_id = ch.job_id LEFT JOIN bi ON bi.candidate_id = ch.candidate_id AND bi.criterion_id = s.cid LEFT JOIN bn ON bn.candidate_id = ch.candidate_id AND bn.nm = s.nm""")
def dossier_matrix(spark: SparkSession, d: str) -> DataFrame:
    return P.dossier(table(spark, d, "candidates"), table(spark, d, "jobs"), _criteria(spark, d), table(spark, d, "evidence"), table(spark, d, "reviews"))


@query("criterion_stats", f"""WITH {_STATED}, {EVID}, cn AS (SELECT job_id, count(DISTINCT id) n FROM candidates GROUP BY 1),
bi AS (SELECT job_id, criterion_id, count(*) FILTER (result = 'matched') m, count(*) FILTER (result = 'partial') p, count(*) FILTER (result = 'unknown') u FROM ev GROUP BY 1, 2), bn AS (SELECT job_id, lower(trim(criterion)) nm, count(*) FILTER (result = 'matched') m, count(*) FILTER (result = 'partial') p, count(*) FILTER (result = 'unknown') u FROM ev GROUP BY 1, 2),
z AS (SELECT s.job_id, s."position", s."label", coalesce(bi.m, bn.m, 0) matched, coalesce(bi.p, bn.p, 0) "partial", coalesce(bi.u, bn.u, 0) "unknown", coalesce(cn.n, 0) n FROM stated s LEFT JOIN bi ON bi.job_id = s.job_id AND bi.criterion_id = s.cid LEFT JOIN bn ON bn.job_id = s.job_id AND bn.nm = s.nm LEFT JOIN cn ON cn.job_id = s.job_id),
y AS (SELECT * EXCLUDE n, CASE WHEN matched + "partial" + "unknown" > 0 THEN matched + "partial" + "unknown" ELSE n END denominator FROM z), x AS (SELECT *, {pct('matched', 'denominator')} matched_pct, {pct('"partial"', 'denominator')} partial_pct, {pct('"unknown"', 'denominator')} unknown_pct FROM y)
SELECT *, CASE WHEN unknown_pct > 80 THEN 'bottleneck' WHEN matched_pct > 90 THEN 'too_common' ELSE 'healthy' END flag FROM x""")
def criterion_stats(spark: SparkSession, d: str) -> DataFrame:
    """Health of every stated criterion by its id, else its label, those without evidence included."""
    return P.criterion_stats(_criteria(spark, d), table(spark, d, "evidence"), table(spark, d, "candidates"))


@query("document_profiles")
def document_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Skills, experience and education of every document by the live profile."""
    return P.profiles(spread(table(spark, d, "documents").select("doc_id", "text")))


@query("ingest_candidates")
def ingest_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The candidates that the documents of the corpus become for one job, with number and kinds of their evidence."""
    new = P.ingest(spread(table(spark, d, "documents")), CRITERIA, "job_ingest", known=table(spark, d, "candidates"))
    n = new.evidence.groupBy(F.col("candidate_id").alias("id")).agg(F.count(F.lit(1)).alias("n_evidence"), F.count_if(F.col("result") == "matched").alias("n_matched"))
    return new.candidates.join(n, "id").join(new.audit.select(F.col("candidate_id").alias("id"), "event_type"), "id")


@query("hiring_summary")
def hiring_summary(spark: SparkSession, d: str) -> DataFrame:
    """All measures of each job in one row."""
    return P.hiring_summary(table(spark, d, "candidates"), table(spark, d, "reviews").distinct(), table(spark, d, "evidence"))
