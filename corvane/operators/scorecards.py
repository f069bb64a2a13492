"""Interview scorecards: validated scores rolled up over all groupings in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.instants import instant
from corvane.functions.text import normalize_role, valid_score


def score_rows(cards: DataFrame, scores: DataFrame) -> DataFrame:
    """One row per valid criterion score with its card's candidate and role."""
    c = cards.select(F.col("id").alias("scorecard_id"), "candidate_id", normalize_role(F.col("role")).alias("role"), "overall_recommendation").distinct()
    s = scores.select("id", "scorecard_id", "criterion_id", valid_score(F.col("score")).alias("score")).distinct().where("score is not null")
    return s.join(c, "scorecard_id")


def interview_summary(cards: DataFrame, scores: DataFrame) -> DataFrame:
    """Mean and count per candidate, per role, per criterion and per both, in one Expand and one aggregate."""
    rows = score_rows(cards, scores).where("candidate_id is not null")
    keys = ["candidate_id", "role", "criterion_id"]
    sets = [["candidate_id"], ["candidate_id", "role"], ["candidate_id", "criterion_id"], keys]
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in keys])
    return out.agg(F.grouping_id().alias("grouping"), (F.sum("score") / F.count(F.lit(1))).alias("mean"), F.count(F.lit(1)).alias("n"))


def card_averages(cards: DataFrame, scores: DataFrame) -> DataFrame:
    """Every scorecard with the mean of its valid scores; null if it has none."""
    mean = score_rows(cards, scores).groupBy("scorecard_id").agg((F.sum("score") / F.count(F.lit(1))).alias("mean"), F.count(F.lit(1)).alias("n"))
    c = cards.select(F.col("id").alias("scorecard_id"), "candidate_id").distinct()
    return c.join(mean, "scorecard_id", "left").select("scorecard_id", "candidate_id", "mean", F.coalesce("n", F.lit(0)).alias("n"))


def role_delta(cards: DataFrame, scores: DataFrame) -> DataFrame:
    """Candidates scored by both roles: means, absolute difference and its sign."""
    rows = score_rows(cards, scores)
    both = rows.groupBy("candidate_id").agg(
        F.count_if(F.col("role") == "recruiter").alias("a"), F.count_if(F.col("role") == "hiring_manager").alias("b"),
        F.sum(F.when(F.col("role") == "recruiter", F.col("score"))).alias("x"), F.sum(F.when(F.col("role") == "hiring_manager", F.col("score"))).alias("y"),
    ).where("a > 0 and b > 0")
    d = F.col("recruiter") - F.col("hiring_manager")
    return both.select("candidate_id", (F.col("x") / F.col("a")).alias("recruiter"), (F.col("y") / F.col("b")).alias("hiring_manager")).select("*", F.abs(d).alias("delta"), F.signum(d).cast("int").alias("sign"))


def nested_cards(cards: DataFrame, scores: DataFrame) -> DataFrame:
    """Every scorecard with its criterion scores as an array, in the order of their ids."""
    s = scores.select("scorecard_id", F.struct("id", "criterion_id", "criterion_label", "score", "evidence_notes").alias("x")).distinct()
    per = s.groupBy("scorecard_id").agg(F.array_sort(F.collect_list("x")).alias("scores"))
    return cards.distinct().join(per, cards.id == per.scorecard_id, "left").drop("scorecard_id")


def interview_profile(cards: DataFrame, scores: DataFrame) -> DataFrame:
    """Per candidate: reviewers (newest last, once each), recommendations in order, scorecards, and the last label of every criterion."""
    c = cards.select("id", "candidate_id", "reviewer", "overall_recommendation", instant(F.col("created_at")).alias("at")).distinct()
    key = F.struct("at", "id", "reviewer", "overall_recommendation")
    per = c.groupBy("candidate_id").agg(F.array_sort(F.collect_list(key)).alias("x"))  # the cards of one candidate
    last = scores.select(F.col("scorecard_id").alias("id"), "criterion_id", "criterion_label").distinct().join(c, "id").groupBy("candidate_id", "criterion_id").agg(F.max_by("criterion_label", F.struct("at", "id")).alias("label"))
    labels = last.groupBy("candidate_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("criterion_id", "label")))).alias("labels"))
    people = F.array_distinct(F.transform("x", lambda r: r["reviewer"]))
    advice = F.filter(F.transform("x", lambda r: r["overall_recommendation"]), lambda r: F.coalesce(r, F.lit("")) != "")
    return per.join(labels, "candidate_id", "left").select("candidate_id", people.alias("reviewers"), advice.alias("recommendations"), F.size("x").alias("n_cards"), "labels")


def record_scorecards(cards: DataFrame, scores: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """New cards and scores checked together: the cards taken, their scores, audit rows for them, and what was refused (id, violations).

    A card needs a candidate, a reviewer, a known role and at least one score, all of its scores whole from 1 to 5. A card is taken as a whole or not at all.
    """
    from corvane.sources.writers import audit_rows

    checked = scores.select("*", valid_score(F.col("score")).alias("__v"))
    per = checked.groupBy(F.col("scorecard_id").alias("id")).agg(F.count(F.lit(1)).alias("__n"), F.count("__v").alias("__good"))
    c = cards.withColumn("role", normalize_role(F.col("role"))).join(per, "id", "left")
    text = lambda x: F.trim(F.coalesce(F.col(x), F.lit(""))) != ""
    rules = {"candidate": text("candidate_id"), "reviewer": text("reviewer"), "role": F.col("role").isin("recruiter", "hiring_manager"), "scores": F.col("__n") > 0, "values": F.coalesce(F.col("__n") == F.col("__good"), F.lit(True))}
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()]))
    judged = c.withColumn("violations", broken)
    good = judged.where(F.size("violations") == 0).select(*cards.columns)
    kept = checked.withColumn("score", F.col("__v")).drop("__v").join(good.select(F.col("id").alias("scorecard_id")), "scorecard_id", "left_semi").select(*scores.columns)
    log = audit_rows(good, "interview_scorecard_recorded", F.col("reviewer"), F.struct(F.col("id").alias("scorecard_id"), "role"))
    return good, kept, log, judged.where(F.size("violations") > 0).select("id", "violations")
