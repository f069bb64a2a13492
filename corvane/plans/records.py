"""Queries over the record tables: broken references (p5) and nested records (p6)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.nested import child_table, flatten_json
from corvane.operators.references import Reference, broken_references, broken_rows, existence_deltas, fold, orphan_report, reference_deltas, reference_rows, suspects
from corvane.session import store, table

CRITERIA = ("$[]", "$.criteria[]")  # criteria_json is the list itself, or an object that holds it
JSON_COLUMNS = (("candidates", "profile_json"), ("jobs", "criteria_json"), ("audit_events", "details_json"))


def _references(spark: SparkSession, d: str) -> list[Reference]:
    cards, audit = table(spark, d, "interview_scorecards"), table(spark, d, "audit_events")
    return [
        Reference("interview_scorecards", cards, "candidate_id", "candidates"),
        Reference("interview_scorecards", cards, "job_id", "jobs"),
        Reference("audit_events", audit, "candidate_id", "candidates"),
    ]


def _broken(spark: SparkSession, d: str) -> DataFrame:
    return broken_references(_references(spark, d), {"candidates": table(spark, d, "candidates"), "jobs": table(spark, d, "jobs")})


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _broken(spark, d).select("src_table", "row_id", "ref_field").distinct()


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Broken references per table, field, reason and month."""
    return orphan_report(_broken(spark, d), "month").select(
        "src_table", "ref_field", "reason", F.col("period").cast("string").alias("period"), "n_references", "n_keys"
    )


def p5_kept_state(spark: SparkSession, d: str) -> DataFrame:
    """The orphans of a state that is kept: the changes up to 2024 are folded and stored, then those since; a third of the jobs is deleted at last.

    All rows take part. A deleted job is one whose id begins with 0 to 4 after its prefix.
    """
    rows = reference_rows(_references(spark, d))
    own = {t: table(spark, d, t).select("id", "created_at").distinct() for t in ("candidates", "jobs")}
    came = [existence_deltas(t, df) for t, df in own.items()]
    early = lambda x, c: x.where(F.coalesce(F.col(c) < F.lit("2024-07-01").cast("timestamp"), F.lit(True)))
    late = lambda x, c: x.where(F.col(c) >= F.lit("2024-07-01").cast("timestamp"))
    named = reference_deltas(rows)
    kept = store(fold(early(named, "named"), *[early(x, "born") for x in came]), "references")
    went = own["jobs"].where(F.substring_index("id", "_", -1).rlike("^[0-4]"))
    now = fold(kept, late(named, "named"), *[late(x, "born") for x in came], existence_deltas("jobs", went, sign=-1))
    return broken_rows(rows, suspects(now)).select("src_table", "row_id", "ref_field", "reason")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        flatten_json(table(spark, d, t), c, attributes=False).select(F.lit(t).alias("src_table"), "row_id", "node_path")
        for t, c in JSON_COLUMNS
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def p6_criteria(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of the criteria of the jobs: one row per criterion, pointing to its job."""
    nodes = flatten_json(table(spark, d, "jobs"), "criteria_json")
    return child_table(nodes, CRITERIA, {"id": "string", "label": "string", "type": "string", "weight": "double"}).distinct()


def p6_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Every child of every kind with its parent and place: an object's members (as JSON text, sorted by name), or a plain element's value."""
    members = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("attributes"))))
    parts = [
        flatten_json(table(spark, d, t), c, every=True).select(
            F.lit(t).alias("src_table"), "row_id", "kind", "node_path", "parent_path", "position", members.alias("members"), "value"
        )
        for t, c in JSON_COLUMNS
    ]
    return reduce(DataFrame.unionByName, parts)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p5_found": p5_found,
    "p5_report": p5_report,
    "p5_kept_state": p5_kept_state,
    "p6_found": p6_found,
    "p6_criteria": p6_criteria,
    "p6_nodes": p6_nodes,
}

_BROKEN_SQL = r"""
WITH norm AS (
  SELECT 'interview_scorecards' src_table, id row_id, 'candidate_id' ref_field, 'candidates' target, candidate_id k, created_at c FROM interview_scorecards
  UNION ALL SELECT 'interview_scorecards', id, 'job_id', 'jobs', job_id, created_at FROM interview_scorecards
  UNION ALL SELECT 'audit_events', id, 'candidate_id', 'candidates', candidate_id, created_at FROM audit_events),
refs AS (
  SELECT src_table, row_id, ref_field, target, lower(regexp_replace(k, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) k,
    TRY_CAST(CASE WHEN regexp_matches(trim(c), '(Z|[+-]\d\d:\d\d)$') THEN trim(c) ELSE trim(c) || '+00:00' END AS TIMESTAMPTZ) t
  FROM norm WHERE k IS NOT NULL),
keys AS (
  SELECT target, lower(trim(id)) k, min(TRY_CAST(CASE WHEN regexp_matches(trim(c), '(Z|[+-]\d\d:\d\d)$') THEN trim(c) ELSE trim(c) || '+00:00' END AS TIMESTAMPTZ)) born
  FROM (SELECT 'candidates' target, id, created_at c FROM candidates UNION ALL SELECT 'jobs', id, created_at FROM jobs) GROUP BY 1, 2),
broken AS (
  SELECT DISTINCT src_table, row_id, ref_field, refs.target, refs.k, t, CASE WHEN keys.k IS NULL THEN 'absent' ELSE 'later' END reason
  FROM refs LEFT JOIN keys ON refs.target = keys.target AND refs.k = keys.k
  WHERE refs.k <> '' AND (keys.k IS NULL OR born > t))
"""

ORACLES: dict[str, str] = {
    "p5_found": _BROKEN_SQL + "SELECT DISTINCT src_table, row_id, ref_field FROM broken",
    "p5_report": _BROKEN_SQL
    + """SELECT src_table, ref_field, reason, strftime(date_trunc('month', t AT TIME ZONE 'UTC'), '%Y-%m-%d') period,
      count(*) n_references, count(DISTINCT k) n_keys FROM broken GROUP BY ALL""",
    "p5_kept_state": _BROKEN_SQL.replace("SELECT 'jobs', id, created_at FROM jobs)", "SELECT 'jobs', id, created_at FROM jobs WHERE NOT regexp_matches(id, '(^|_)[0-4][^_]*$'))").replace("THEN 'absent'", "THEN CASE WHEN refs.target = 'jobs' AND refs.k IN (SELECT lower(trim(id)) FROM jobs) THEN 'deleted' ELSE 'absent' END")
    + "SELECT DISTINCT src_table, row_id, ref_field, reason FROM broken",
    "p6_found": r"""
WITH RECURSIVE src AS (
  SELECT 'candidates' src_table, id row_id, profile_json j FROM candidates
  UNION SELECT 'jobs', id, criteria_json FROM jobs
  UNION SELECT 'audit_events', id, details_json FROM audit_events),
t(src_table, row_id, node_path, elem, v) AS (
  SELECT src_table, row_id, '$', false, CAST(j AS JSON) FROM src WHERE json_valid(j)
  UNION ALL
  SELECT src_table, row_id, p, e, w FROM (
    SELECT src_table, row_id, node_path p, elem e, CAST(v ->> '$' AS JSON) w FROM t WHERE json_type(v) = 'VARCHAR' AND json_valid(v ->> '$')
    UNION ALL
    SELECT src_table, row_id, node_path || '[' || i || ']', true, json_extract(v, '$[' || i || ']')
    FROM (SELECT *, unnest(range(json_array_length(v)::BIGINT)) i FROM t WHERE json_type(v) = 'ARRAY')
    UNION ALL
    SELECT src_table, row_id, node_path || '.' || k, false, json_extract(v, '$."' || k || '"')
    FROM (SELECT *, unnest(json_keys(v)) k FROM t WHERE json_type(v) = 'OBJECT')))
SELECT DISTINCT src_table, row_id, node_path FROM t WHERE elem AND json_type(v) = 'OBJECT'""",
    "p6_criteria": r"""
WITH RECURSIVE t(row_id, p, v) AS (
  SELECT id, '$', CAST(criteria_json AS JSON) FROM jobs WHERE json_valid(criteria_json)
  UNION ALL SELECT row_id, p, w FROM (
    SELECT row_id, p, CAST(v ->> '$' AS JSON) w FROM t WHERE json_type(v) = 'VARCHAR' AND json_valid(v ->> '$')
    UNION ALL SELECT row_id, '$.criteria', json_extract(v, '$.criteria') FROM t WHERE p = '$' AND json_type(v) = 'OBJECT' AND list_contains(json_keys(v), 'criteria'))),
e AS (SELECT row_id, p, i, json_extract(v, '$[' || i || ']') o FROM (SELECT *, unnest(range(json_array_length(v)::BIGINT)) i FROM t WHERE json_type(v) = 'ARRAY'))
SELECT DISTINCT row_id, p || '[' || i || ']' node_path, CAST(NULL AS VARCHAR) parent_path, CAST(i AS INT) "position",
  o ->> '$.id' id, o ->> '$.label' "label", o ->> '$.type' "type", TRY_CAST(o ->> '$.weight' AS DOUBLE) weight
FROM e WHERE json_type(o) = 'OBJECT'""",
}
