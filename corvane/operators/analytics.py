"""Review and evidence analytics, for all jobs at once: every function takes tables and groups by job.

A single job is a filter on the result. Percentages are exact to a tenth by integer arithmetic, sums
of doubles go through decimals, so results do not depend on the order of rows. Exact copies of rows
are dropped first; aggregates are partial before each shuffle, so a job of any size costs one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.instants import instant
from corvane.functions.text import EMAIL, normalize_role

STATUSES = ("needs_review", "advance", "needs_info", "not_selected")


def percent(part: Column, whole: Column) -> Column:
    """100·part/whole to a tenth, half up, for counts; 0.0 if whole is 0."""
    exact = F.call_function("div", part * 2000 + whole, whole * 2)
    return F.when(whole > 0, exact / F.lit(10.0)).otherwise(F.lit(0.0))


def exact_sum(x: Column, scale: int = 6) -> Column:
    return F.sum(x.cast(f"decimal(18,{scale})")).cast("double")


def clean_status(status: Column) -> Column:
    """Null and empty count as needs_review; anything else is trimmed."""
    return F.when(status.isNull() | (status == ""), "needs_review").otherwise(F.trim(status))


def scored(candidates: DataFrame) -> DataFrame:
    """Candidates once each, with NaN scores as null, clean status and created_at as instant."""
    return candidates.select(
        "id", "job_id", F.when(~F.isnan("score"), F.col("score")).alias("score"), clean_status(F.col("status")).alias("status"), instant(F.col("created_at")).alias("at")
    ).distinct()


def job_funnel(candidates: DataFrame) -> DataFrame:
    """Per job and status: n, pct of the job. The canonical statuses are always there, others are appended."""
    c = scored(candidates)
    seen = c.groupBy("job_id", "status").agg(F.count(F.lit(1)).alias("n"))
    jobs = c.select("job_id").distinct()
    zero = jobs.select("job_id", F.explode(F.array(*[F.lit(s) for s in STATUSES])).alias("status"), F.lit(0).cast("bigint").alias("n"))
    per = seen.unionByName(zero).groupBy("job_id", "status").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("job_id"))
    return per.select("job_id", "status", "n", percent(F.col("n"), total).alias("pct"))


def job_scores(candidates: DataFrame) -> DataFrame:
    """Per job: n, avg, min and max of the score."""
    return scored(candidates).groupBy("job_id").agg(
        F.count(F.lit(1)).alias("n"), (exact_sum(F.col("score")) / F.count("score")).alias("avg_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score")
    )


def jobs_with_counts(jobs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every job with its number of candidates; counted before the join."""
    n = candidates.select("id", "job_id").distinct().groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))
    return jobs.select(F.col("id").alias("job_id"), "title").distinct().join(n, "job_id", "left").select("job_id", "title", F.coalesce("n", F.lit(0)).alias("n_candidates"))


def latest_reviews(reviews: DataFrame, by_role: bool = True, note: bool = False) -> DataFrame:
    """The newest review of each candidate (and role): reviewer, decision, at, and its ``note`` if asked for. Equal times go to the larger id."""
    r = reviews.select("id", "candidate_id", normalize_role(F.col("role")).alias("role"), "reviewer", "decision", instant(F.col("created_at")).alias("at"), *[F.trim("note").alias("note")] * note)
    keys = ["candidate_id", "role"] if by_role else ["candidate_id"]
    last = F.max_by(F.struct("role", "reviewer", "decision", "at", *["note"] * note), F.struct("at", "id")).alias("x")
    out = r.groupBy(*keys).agg(last)
    return out.select("candidate_id", "x.role", "x.reviewer", "x.decision", "x.at", *["x.note"] * note)


def role_pairs(reviews: DataFrame) -> DataFrame:
    """Candidates whom both roles reviewed: recruiter and hiring_manager decision."""
    last = latest_reviews(reviews).where(F.col("role").isin("recruiter", "hiring_manager"))
    both = last.groupBy("candidate_id").agg(
        F.max(F.when(F.col("role") == "recruiter", F.col("decision"))).alias("recruiter"), F.max(F.when(F.col("role") == "hiring_manager", F.col("decision"))).alias("hiring_manager")
    )
    return both.where(F.col("recruiter").isNotNull() & F.col("hiring_manager").isNotNull())


def agreement(reviews: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per job: candidates with both roles' reviews, those in consensus, and the rate."""
    pairs = role_pairs(reviews).join(candidates.select(F.col("id").alias("candidate_id"), "job_id").distinct(), "candidate_id")
    same = F.count_if(F.col("recruiter") == F.col("hiring_manager"))
    return pairs.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_dual"), same.alias("n_consensus"), percent(same, F.count(F.lit(1))).alias("consensus_pct"))


def divergences(reviews: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates whose two roles disagree, with score and status."""
    c = scored(candidates).select(F.col("id").alias("candidate_id"), "job_id", "score", "status")
    return role_pairs(reviews).where("recruiter <> hiring_manager").join(c, "candidate_id")


def cohen_kappa(pairs: DataFrame, left: str, right: str, keys: Sequence[str] = (), degenerate: str = "agreement") -> DataFrame:
    """Cohen's kappa of two label columns per ``keys``: n, observed, expected, kappa.

    If the expected agreement is 1, kappa is 1.0 on full agreement and else 0.0 (``degenerate="agreement"``), or
    null (``"null"``). Rows with a null label are left out. Only counts per label pair are shuffled on.
    """
    k = list(keys)
    cells = pairs.dropna(subset=[left, right]).groupBy(*k, F.col(left).alias("l"), F.col(right).alias("r")).agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(*k, F.explode(F.array(F.struct(F.lit(0).alias("s"), F.col("l").alias("c")), F.struct(F.lit(1).alias("s"), F.col("r").alias("c")))).alias("x"), "n")
    marg = sides.groupBy(*k, F.col("x.c").alias("c")).agg(F.sum(F.when(F.col("x.s") == 0, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("x.s") == 1, F.col("n")).otherwise(0)).alias("b"))
    expected = marg.groupBy(*k).agg(F.sum(F.col("a") * F.col("b")).alias("ab")) if k else marg.agg(F.sum(F.col("a") * F.col("b")).alias("ab"))
    total = [F.sum("n").alias("n"), F.sum(F.when(F.col("l") == F.col("r"), F.col("n")).otherwise(0)).alias("same")]
    seen = cells.groupBy(*k).agg(*total) if k else cells.agg(*total)
    both = seen.join(expected, k) if k else seen.crossJoin(F.broadcast(expected))  # one row on either side
    po, pe = F.col("same") / F.col("n"), F.col("ab") / (F.col("n") * F.col("n"))
    edge = F.when(po >= 1.0, 1.0).otherwise(0.0) if degenerate == "agreement" else F.lit(None).cast("double")
    return both.select(*k, "n", po.alias("observed"), pe.alias("expected"), F.when(F.col("ab") >= F.col("n") * F.col("n"), edge).otherwise((po - pe) / (F.lit(1.0) - pe)).alias("kappa"))


def kappa_band(kappa: Column) -> Column:
    """Landis and Koch's words for the value rounded to three places."""
    k = F.bround(kappa, 3)
    return (
        F.when(k >= 0.81, "almost perfect").when(k >= 0.61, "substantial").when(k >= 0.41, "moderate").when(k >= 0.21, "fair").when(k >= 0, "slight").otherwise("poor")
    )


def evidence_of_jobs(evidence: DataFrame, candidates: DataFrame) -> DataFrame:
    """Evidence rows once each, with their job."""
    e = evidence.select("id", "candidate_id", "criterion_id", "criterion", "requirement_type", "weight", "result", "snippet", "page_number").distinct()
    return e.join(candidates.select(F.col("id").alias("candidate_id"), "job_id").distinct(), "candidate_id")


def criteria_health(evidence: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per job and criterion: counts and shares of matched, partial, unknown; other results count in neither.

    ``bottleneck``: over 80 % unknown; else ``too_common``: over 90 % matched, both on the rounded share.
    """
    e = evidence_of_jobs(evidence, candidates)
    per = e.groupBy("job_id", "criterion_id").agg(
        F.min("criterion").alias("criterion"), *[F.count_if(F.col("result") == r).alias(r) for r in ("matched", "partial", "unknown")]
    )
    n = F.col("matched") + F.col("partial") + F.col("unknown")
    out = per.select("*", n.alias("evaluated"), *[percent(F.col(r), n).alias(f"{r}_pct") for r in ("matched", "partial", "unknown")])
    return out.withColumn("flag", F.when(F.col("unknown_pct") > 80, "bottleneck").when(F.col("matched_pct") > 90, "too_common").otherwise("healthy"))


def grounding_audit(evidence: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per job: positive rows, those with a snippet, those with a page; faithfulness and attribution in percent.

    A job without positives has 100.0. Mean length is of the trimmed snippets of positives.
    """
    e = evidence_of_jobs(evidence, candidates)
    pos = F.col("result").isin("matched", "partial")
    text = F.trim(F.coalesce("snippet", F.lit("")))
    grounded = pos & (text != "") & (text != "[redacted]")
    cells = e.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(pos).alias("positives"), F.count_if(grounded).alias("grounded"),
        F.count_if(pos & F.col("page_number").isNotNull()).alias("attributed"), F.sum(F.when(pos, F.length(text)).otherwise(0)).alias("chars"),
    )
    share = lambda c: F.when(F.col("positives") > 0, percent(F.col(c), F.col("positives"))).otherwise(100.0)
    return cells.select("job_id", "n_rows", "positives", "grounded", "attributed", share("grounded").alias("faithfulness"), share("attributed").alias("attribution"), (F.col("chars") / F.nullif(F.col("positives"), F.lit(0))).alias("mean_chars"))


def pii_audit(evidence: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per job: positive rows, those whose snippet holds a mail address, compliance in percent."""
    e = evidence_of_jobs(evidence, candidates).where(F.col("result").isin("matched", "partial"))
    leak = F.count_if(F.coalesce(F.col("snippet").rlike(EMAIL), F.lit(False)))
    return e.groupBy("job_id").agg(F.count(F.lit(1)).alias("positives"), leak.alias("leaks"), percent(F.count(F.lit(1)) - leak, F.count(F.lit(1))).alias("compliance"))


def relevance(candidates: DataFrame, reviews: DataFrame) -> DataFrame:
    """Candidates with a grade from their newest review: advance 2, needs_info 1, else 0."""
    d = latest_reviews(reviews, by_role=False).select("candidate_id", "decision")
    c = scored(candidates).where("job_id is not null")
    grade = F.when(F.col("decision") == "advance", 2).when(F.col("decision") == "needs_info", 1).otherwise(0)
    return c.join(d, c.id == d.candidate_id, "left").select("id", "job_id", "score", "at", grade.alias("rel"), F.col("decision").isNotNull().alias("reviewed"))


def ranking_quality(graded: DataFrame, k: int, all_zero: bool = True) -> DataFrame:
    """Per job: MRR, NDCG@k and precision@k of the order by score.

    Only the first k of each job and the counts of its grades are needed: the ideal order of grades follows
    from their counts, and the first k by score come from a heap per task, not from a sort of the job.
    ``all_zero``: NDCG of a job whose reviewed candidates all have grade 0 is 1.0, else 0.0.
    """
    key = F.struct((-F.coalesce("score", F.lit(float("-inf")))).alias("s"), "at", "id", "rel")
    # max_by-like heap: rows before the first relevant one are found by a count below
    best = graded.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("reviewed")).alias("n_reviewed"),
        *[F.count_if(F.col("rel") == g).alias(f"g{g}") for g in (1, 2)], F.min(F.when(F.col("rel") >= 1, key)).alias("first"),
    )
    w = Window.partitionBy("job_id").orderBy(F.col("score").desc_nulls_last(), F.col("at").asc_nulls_first(), F.col("id").asc())
    # a row_number filter by a constant is pushed below the shuffle as a per-task limit per group
    top = graded.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    gain = (F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(F.col("rank") + 1.0)
    head = top.groupBy("job_id").agg(F.sum(gain.cast("decimal(20,10)")).cast("double").alias("dcg"), F.sum(F.when(F.col("rel") >= 1, 1).otherwise(0)).alias("hits"))
    ahead = graded.join(best.select("job_id", "first"), "job_id").where(F.col("first").isNotNull() & (key < F.col("first")))
    place = ahead.groupBy("job_id").agg((F.count(F.lit(1)) + 1).alias("place"))
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.least(F.lit(k).cast("bigint"), F.col("n"))),
        F.lit(0).cast("decimal(20,10)"),
        lambda a, i: (a + (F.when(i <= F.col("g2"), 3.0).when(i <= F.col("g2") + F.col("g1"), 1.0).otherwise(0.0) / F.log2(i + 1.0)).cast("decimal(20,10)")).cast("decimal(20,10)"),
    ).cast("double")
    out = best.join(head, "job_id").join(place, "job_id", "left").withColumn("ideal", ideal)
    flat = F.when((F.col("n_reviewed") > 0) & F.lit(all_zero), 1.0).otherwise(0.0)
    return out.select(
        "job_id", "n",
        F.when(F.col("first").isNull(), 0.0).otherwise(F.lit(1.0) / F.coalesce("place", F.lit(1))).alias("mrr"),
        F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(flat).alias("ndcg"),
        (F.col("hits") / F.least(F.lit(k).cast("bigint"), F.col("n"))).alias("precision"),
    )


def candidate_counts(candidates: DataFrame, evidence: DataFrame, reviews: DataFrame) -> DataFrame:
    """The rows of the candidate export: evidence counts and newest review ("-" if none)."""
    e = evidence.select("id", "candidate_id", "result").distinct().groupBy("candidate_id").agg(*[F.count_if(F.col("result") == r).alias(r) for r in ("matched", "partial", "unknown")])
    r = latest_reviews(reviews, by_role=False)
    c = scored(candidates).select(F.col("id").alias("candidate_id"), "job_id", "score", "status")
    dash = lambda x: F.coalesce(F.nullif(F.trim(x), F.lit("")), F.lit("-")).alias(x)
    return c.join(e, "candidate_id", "left").join(r, "candidate_id", "left").select(
        "candidate_id", "job_id", "score", "status", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("matched", "partial", "unknown")], dash("reviewer"), dash("role"), dash("decision")
    )


def calibration(criteria: DataFrame, keys: Sequence[str] = ("job_id",)) -> DataFrame:
    """Balance of the weights of each job's criteria (columns label, type, weight): verdict and ratios.

    Negative and null weights count as 0. In order: empty, unbalanced (one share over .40), too_strict (no preferred, or
    required share .90 and over), too_loose (preferred outweighs required), too_few (<3), too_many (>8), well_calibrated.
    """
    w = F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).cast("decimal(18,6)")
    required = F.coalesce(F.col("type"), F.lit("")) == "required"
    per = criteria.groupBy(*keys).agg(
        F.count("label").alias("n"), F.sum(w).cast("double").alias("total"), F.sum(F.when(required, w).otherwise(0)).cast("double").alias("required"),
        F.max(w).cast("double").alias("largest"), F.count_if(~required & F.col("label").isNotNull()).alias("n_preferred"),
    )
    share = lambda c: F.when(F.col("total") > 0, F.col(c) / F.col("total")).otherwise(0.0)
    verdict = (
        F.when((F.col("n") == 0) | (F.col("total") <= 0), "empty").when(share("largest") > 0.40, "unbalanced").when((F.col("n_preferred") == 0) | (share("required") >= 0.90), "too_strict")
        .when(F.col("required") < F.col("total") - F.col("required"), "too_loose").when(F.col("n") < 3, "too_few").when(F.col("n") > 8, "too_many").otherwise("well_calibrated")
    )
    return per.select(*keys, "n", "total", share("required").alias("required_share"), share("largest").alias("largest_share"), verdict.alias("verdict"))


def largest_remainder(counts: DataFrame, keys: Sequence[str], category: str, n: str, units: int = 1000) -> DataFrame:
    """Shares of ``units`` whole units per group that add up: floors first, then one each to the largest remainders."""
    group = Window.partitionBy(*keys)
    total = F.sum(n).over(group)
    floor = F.when(total > 0, F.call_function("div", F.col(n) * units, total)).otherwise(0)
    rest = F.when(total > 0, F.col(n) * units % total).otherwise(0)
    a = counts.select("*", floor.alias("__f"), rest.alias("__r"), total.alias("__t"))
    a = a.withColumn("__left", F.when(F.col("__t") > 0, F.lit(units) - F.sum("__f").over(group)).otherwise(0))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("__r").desc(), F.col(category).asc()))
    return a.select(*keys, category, n, (F.col("__f") + F.when(place <= F.col("__left"), 1).otherwise(0)).alias("units"))


def score_distribution(candidates: DataFrame, group: str = "job_id") -> DataFrame:
    """n, min, max, mean, median, sample deviation (0 for one value), 90th percentile and buckets of the scores."""
    from corvane.operators.positions import quantiles

    s = scored(candidates).where("score is not null")
    dev = F.when(F.count("score") > 1, F.stddev_samp("score")).otherwise(0.0)
    edges = ((80, None), (60, 80), (40, 60), (20, 40), (None, 20))
    within = lambda lo, hi: (F.col("score") >= lo if lo is not None else F.lit(True)) & (F.col("score") < hi if hi is not None else F.lit(True))
    per = s.groupBy(group).agg(
        F.count("score").alias("n"), F.min("score").alias("min"), F.max("score").alias("max"), (exact_sum(F.col("score")) / F.count("score")).alias("mean"),
        F.round(dev, 6).alias("stdev"), *[F.count_if(within(lo, hi)).alias(f"from_{lo or 0}") for lo, hi in edges],
    )
    q = quantiles(s, group, "score", {"median": 0.5, "p90": 0.9}).withColumnRenamed(group, "__k")
    return per.join(q, F.col(group).eqNullSafe(F.col("__k"))).select(group, "n", "min", "max", "mean", "median", "stdev", "p90", *[f"from_{lo or 0}" for lo, _ in edges])


def comparison_divergence(evidence: DataFrame) -> DataFrame:
    """Per criterion: distinct results, whether they diverge, and whether both matched and unknown occur."""
    e = evidence.select("id", "criterion_id", "result").distinct()
    return e.groupBy("criterion_id").agg(
        F.countDistinct("result").alias("n_results"), (F.countDistinct("result") > 1).alias("diverges"),
        ((F.max((F.col("result") == "matched").cast("int")) == 1) & (F.max((F.col("result") == "unknown").cast("int")) == 1)).alias("matched_and_unknown"),
    )


def rolling_limit(events: DataFrame, key: str, at: str, seconds: int = 60, most: int = 6) -> DataFrame:
    """Each event with the number of its key's events in the ``seconds`` up to it, and whether that is within ``most``."""
    w = Window.partitionBy(key).orderBy(F.unix_seconds(F.col(at).cast("timestamp"))).rangeBetween(-(seconds - 1), 0)
    n = F.count(F.lit(1)).over(w)
    return events.withColumn("n_window", n).withColumn("within", n <= most)
