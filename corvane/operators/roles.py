"""Cascades and catalogues: the first rule that fits a text, presets by role, and the template that fits a label best.

Rules, presets and templates are tables or lists that the caller brings; small ones by their nature, as people write them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import contains_text


@dataclass(frozen=True)
class Rule:
    """``key`` where one of ``words`` is in the text (``title_only``: in the title alone)."""

    key: str
    words: tuple[str, ...]
    title_only: bool = False


# Rules by which titles and departments are told; the first that fits counts.
ROLES = (
    Rule("backend_developer", ("backend", "back end", "python dev", "api engineer"), True),
    Rule("frontend_developer", ("frontend", "front end", "ui dev", "react dev", "web dev"), True),
    Rule("software_developer", ("software", "developer", "programmer", "android", "fullstack", "full stack")),
    Rule("network_administrator", ("network", "jaringan", "cisco")),
    Rule("systems_administrator", ("sysadmin", "system admin", "systems admin", "infrastructure", "it support")),
    Rule("security_analyst", ("cyber", "security", "keamanan", "infosec")),
    Rule("devops_engineer", ("devops", "cloud engineer", "site reliability", "platform engineer")),
    Rule("data_scientist", ("data scientist", "machine learning", "ml engineer")),
    Rule("data_analyst", ("data analyst", "business intelligence", "analytics")),
    Rule("accountant", ("accountant", "akuntan", "accounting", "finance", "keuangan", "tax")),
    Rule("hr_specialist", ("recruiter", "human resource", "talent", "personalia", "sdm")),
    Rule("product_manager", ("product manager", "product owner", "project manager")),
)


def plain_words(text: Column) -> Column:
    """Lower case, everything but letters and digits as single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w]+", " "))


def role_key(title: Column, department: Column, rules: Sequence[Rule] = ROLES, fallback: str = "general") -> Column:
    """The key of the first rule with a word in the title (and department)."""
    t = plain_words(title)
    both = F.concat(t, F.lit(" "), plain_words(department))
    out = F.lit(fallback)
    for r in reversed(rules):
        where = t if r.title_only else both
        hit = F.lit(False)
        for w in r.words:
            hit = hit | F.contains(where, F.lit(w))
        out = F.when(hit, r.key).otherwise(out)
    return out


def recommendations(jobs: DataFrame, presets: DataFrame, rules: Sequence[Rule] = ROLES, most: int = 6, required: float = 1.0, preferred: float = 0.8) -> DataFrame:
    """Preset criteria of each job's role: job_id, role, place, label, type, weight; at most ``most`` in the order of ``presets`` (role, no, label, type), those of ``general`` where a role has none."""
    j = jobs.select(F.col("id").alias("job_id"), role_key(F.col("title"), F.col("department"), rules).alias("role")).distinct()
    p = presets.withColumn("place", F.row_number().over(Window.partitionBy("role").orderBy("no"))).where(F.col("place") <= most).select("role", "place", "label", "type")
    known = p.select("role").distinct().withColumn("known", F.lit(True))
    used = j.join(known, "role", "left").select("job_id", "role", F.when(F.col("known"), F.col("role")).otherwise("general").alias("from"))
    weight = F.when(F.col("type") == "required", required).otherwise(preferred)
    return used.join(p.withColumnRenamed("role", "from"), "from").select("job_id", "role", "place", "label", "type", weight.alias("weight"))


def best_template(labels: DataFrame, bank: DataFrame, aliases: DataFrame, label: str = "label") -> DataFrame:
    """``labels`` with the key of the template that fits: equal, else contained either way (the first in ``bank``: key, no), else by an alias in the label
    (the first in ``aliases``: alias, key, no); null if none, where the caller makes one up. Labels are matched once each, so a hot one costs no more."""
    text = plain_words(F.col(label))
    each = labels.select(text.alias("t")).distinct()
    k = bank.select(plain_words(F.col("key")).alias("word"), "key", F.col("no").alias("place"))
    a = aliases.join(bank.select("key"), "key", "left_semi").select(plain_words(F.col("alias")).alias("word"), "key", F.col("no").alias("place"))
    same, either = F.col("t") == F.col("word"), F.contains("t", "word") | F.contains("word", "t")
    found = each.where("t <> ''").join(F.broadcast(k), either).select("t", F.struct(F.when(same, 0).otherwise(1).alias("p"), "place", "key").alias("x"))  # short lists that people write
    found = found.unionByName(each.where("t <> ''").join(F.broadcast(a), F.contains("t", "word")).select("t", F.struct(F.lit(2).alias("p"), "place", "key").alias("x")))
    best = found.groupBy("t").agg(F.min("x").alias("x")).select("t", F.col("x.key").alias("template"))
    return labels.withColumn("__t", text).join(best.withColumnRenamed("t", "__t"), "__t", "left").drop("__t")


def search(candidates: DataFrame, text: str = "", status: str = "all", columns: Sequence[str] = ("id", "status", "file_type", "profile_json")) -> DataFrame:
    """Candidates that hold ``text`` in one of ``columns`` or in the last four characters of their id, with a status if not ``all``."""
    hit = contains_text(text, F.right("id", F.lit(4)), *[F.col(c) for c in columns]) if text.strip() else F.lit(True)
    return candidates.where(hit & (F.lit(True) if status == "all" else F.col("status") == status))


def in_order(candidates: DataFrame, mode: str = "score_desc") -> DataFrame:
    """Sort modes of a list: score or date, asc or desc; ties by id."""
    by, way = mode.split("_")
    key = F.col("score") if by == "score" else F.col("created_at")
    if by not in ("score", "date") or way not in ("asc", "desc"):
        raise ValueError(f"unknown order {mode}")
    return candidates.orderBy(key.desc_nulls_last() if way == "desc" else key.asc_nulls_last(), "id")


def compared(evidence: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """Two or three candidates side by side: criterion_id, criterion, results (by candidate), diverges, matched_and_unknown."""
    if not 2 <= len(set(candidates)) <= 3:
        raise ValueError("compare two or three candidates")
    e = evidence.where(F.col("candidate_id").isin(*candidates)).select("candidate_id", "criterion_id", "criterion", "result").distinct()
    per = e.groupBy("criterion_id").agg(F.min("criterion").alias("criterion"), F.map_from_entries(F.array_sort(F.collect_set(F.struct("candidate_id", "result")))).alias("results"))  # at most three
    kinds = F.array_distinct(F.map_values("results"))
    return per.select("criterion_id", "criterion", "results", (F.size(kinds) > 1).alias("diverges"), (F.array_contains(kinds, "matched") & F.array_contains(kinds, "unknown")).alias("matched_and_unknown"))
