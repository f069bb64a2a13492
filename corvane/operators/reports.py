"""What leaves the database: exports, reports, feedback and dossiers, for all jobs at once, and the plan that takes documents in.

One row per candidate carries its evidence and reviews as arrays, which are as long as a candidate has rows; no row holds a whole job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import fixed as X
from corvane.functions import text as T
from corvane.functions.instants import instant
from corvane.operators.analytics import candidate_counts, clean_status, latest_reviews, scored
from corvane.operators.matching import Criterion, match_documents, score
from corvane.session import store

NEWEST = "created_at DESC, id DESC"


def _strict(json: Column) -> Column:
    """The value of a JSON text in a list of one; null if anything else follows it, which the parser alone would let pass."""
    return F.try_parse_json(F.concat(F.lit("["), json, F.lit("]")))


def _text_list(json: Column, name: str) -> Column:
    """A list in a JSON text as one text with commas (of objects their skill_name); a single value as it is; else null."""
    v, path = _strict(json), f"$[0].{name}"
    each = lambda x: F.coalesce(F.try_variant_get(x, "$.skill_name", "string"), F.try_variant_get(x, "$", "string"))
    return F.coalesce(F.array_join(F.transform(F.try_variant_get(v, path, "array<variant>"), each), ", "), F.try_variant_get(v, path, "string"))


def profile_columns(json: Column) -> dict[str, Column]:
    """Skills, years and education of a flat profile as text; empty where absent or the JSON is broken."""
    # numbers as they are written, so not through a variant
    written = F.coalesce(F.get_json_object(json, "$.experience_years_mentioned"), F.get_json_object(json, "$.experience_years"))
    years = F.when(_strict(json).isNotNull(), written)
    education = F.coalesce(_text_list(json, "education_levels_mentioned"), _text_list(json, "education"))
    empty = lambda c: F.coalesce(c, F.lit(""))
    return {"skills": empty(_text_list(json, "skills")), "experience_years": empty(years), "education": empty(education)}


def review_history(reviews: DataFrame) -> DataFrame:
    """Per candidate its reviews, newest first: candidate_id, reviews (reviewer, role, decision, note, created_at)."""
    r = reviews.select("id", "candidate_id", "reviewer", "role", "decision", F.trim("note").alias("note"), "created_at").distinct()
    x = F.struct(F.coalesce(F.unix_micros(instant(F.col("created_at"))), F.lit(-(1 << 62))).alias("at"), "id", "reviewer", "role", "decision", "note", "created_at")
    return r.groupBy("candidate_id").agg(F.transform(F.sort_array(F.collect_list(x), asc=False), lambda y: y.dropFields("at", "id")).alias("reviews"))


def evidence_lists(evidence: DataFrame) -> DataFrame:
    """Per candidate its evidence, by weight descending and criterion: candidate_id, evidence."""
    e = evidence.select("id", "candidate_id", "criterion_id", "criterion", "requirement_type", "weight", "result", "confidence", F.trim(F.coalesce("snippet", F.lit(""))).alias("snippet"), "page_number").distinct()
    x = F.struct((-F.coalesce("weight", F.lit(0.0))).alias("o"), "criterion", "id", "criterion_id", "requirement_type", "weight", "result", "confidence", "snippet", "page_number")
    return e.groupBy("candidate_id").agg(F.transform(F.array_sort(F.collect_list(x)), lambda y: y.dropFields("o", "id")).alias("evidence"))


def candidates_csv(candidates: DataFrame, reviews: DataFrame) -> DataFrame:
    """The candidate export: ten columns and job_id; the decision is that of the newest review, else a status other than needs_review; all notes, newest first."""
    c = candidates.select("id", "job_id", "file_type", F.when(~F.isnan("score"), F.col("score")).alias("score"), "status", "created_at", *[v.alias(k) for k, v in profile_columns(F.col("profile_json")).items()]).distinct()
    h = review_history(reviews)
    notes = F.array_join(F.filter(F.transform("reviews", lambda r: r["note"]), lambda n: n != ""), " | ")
    status = F.when(~F.coalesce(F.col("status"), F.lit("")).isin("", "needs_review"), F.col("status")).otherwise("")
    j = c.join(h.withColumnRenamed("candidate_id", "id"), "id", "left")
    return j.select(
        F.col("id").alias("candidate_id"), "job_id", "file_type", "score", "status", "skills", "experience_years", "education",
        F.when(F.size("reviews") > 0, F.coalesce(F.col("reviews")[0]["decision"], F.lit(""))).otherwise(status).alias("reviewer_decision"),
        F.coalesce(notes, F.lit("")).alias("reviewer_notes"), "created_at",
    )


def evidence_csv(evidence: DataFrame, candidates: DataFrame) -> DataFrame:
    """The evidence export: job_id and eight columns, with the keys of its order (score, at, weight, criterion) as ``sort``."""
    e = evidence.select("id", "candidate_id", "criterion", "requirement_type", "weight", "result", "confidence", "snippet", "page_number").distinct()
    c = scored(candidates).select(F.col("id").alias("candidate_id"), "job_id", "score", "at").distinct()
    sort = F.struct((-F.coalesce("score", F.lit(0.0))).alias("score"), "at", (-F.col("weight")).alias("weight"), "criterion")
    return e.join(c, "candidate_id").select("job_id", "candidate_id", "criterion", "requirement_type", "weight", "result", "confidence", "snippet", F.coalesce(F.col("page_number").cast("string"), F.lit("")).alias("page_number"), sort.alias("sort"))


def review_table(candidates: DataFrame, evidence: DataFrame, reviews: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """The 16 columns of the review table: ``labels`` are the words for the statuses; counts of evidence, newest review with its note ("-" if none)."""
    c = candidates.select(F.col("id").alias("candidate_id"), "job_id", F.upper("file_type").alias("format"), "created_at", *[v.alias(k) for k, v in profile_columns(F.col("profile_json")).items()]).distinct()
    last = latest_reviews(reviews, by_role=False, note=True).select("candidate_id", "note")
    words = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    named = lambda c: F.coalesce(words[F.col(c)], F.col(c)).alias(c)
    n = candidate_counts(candidates, evidence, reviews).drop("job_id")
    return c.join(n, "candidate_id").join(last, "candidate_id", "left").select(
        "job_id", "candidate_id", F.upper(F.right("candidate_id", F.lit(4))).alias("label"), F.bround("score", 0).cast("int").alias("score"), named("status"), "format",
        F.coalesce(F.nullif("experience_years", F.lit("")), F.lit("-")).alias("experience_years"), "education", "skills", "matched", "partial", "unknown", "reviewer", "role", named("decision"),
        F.coalesce("note", F.lit("")).alias("note"), "created_at",
    )


def candidate_reports(candidates: DataFrame, evidence: DataFrame, reviews: DataFrame) -> DataFrame:
    """One JSON document per candidate with evidence and reviews: job_id, candidate_id, report. Written by job, they make up the job's report."""
    c = candidates.select("id", "job_id", F.when(~F.isnan("score"), F.col("score")).alias("score"), clean_status(F.col("status")).alias("status"), "created_at").distinct()
    key = lambda df: df.withColumnRenamed("candidate_id", "id")
    j = c.join(key(evidence_lists(evidence)), "id", "left").join(key(review_history(reviews)), "id", "left")
    return j.select("job_id", F.col("id").alias("candidate_id"), F.to_json(F.struct("id", "score", "status", "created_at", F.coalesce("evidence", F.array()).alias("evidence"), F.coalesce("reviews", F.array()).alias("reviews"))).alias("report"))


def report_headers(jobs: DataFrame, candidates: DataFrame, audit: DataFrame) -> DataFrame:
    """One row per job: title, department, candidates, audit events and the time of the last: the head of its report."""
    j = jobs.select(F.col("id").alias("job_id"), "title", "department", "status").distinct()
    c = candidates.select("id", "job_id").distinct().groupBy("job_id").agg(F.count(F.lit(1)).alias("n_candidates"))
    a = audit.select("id", "job_id", "created_at").distinct().groupBy("job_id").agg(F.count(F.lit(1)).alias("n_events"), F.unix_micros(F.max(instant(F.col("created_at")))).alias("last_event_us"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return j.join(c, "job_id", "left").join(a, "job_id", "left").select("job_id", "title", "department", "status", zero("n_candidates"), zero("n_events"), "last_event_us")


def audit_trail(audit: DataFrame) -> DataFrame:
    """Every audit event once with its place in the job's trail key: job_id, us, id, actor, event_type, details_json. Order by job_id, us, id."""
    return audit.select("job_id", F.unix_micros(instant(F.col("created_at"))).alias("us"), "id", "candidate_id", "actor", "event_type", "details_json").distinct()


@dataclass(frozen=True)
class FeedbackWords:
    """The phrases of feedback; ``{criterion}``, ``{title}``, ``{snippet}`` and ``{reviewers}`` stand for the values."""

    strong: str = "'{criterion}' is shown by the file: \"{snippet}\"."
    named: str = "'{criterion}' meets the standard for {title}."
    partly: str = "'{criterion}' is shown in part: \"{snippet}\". More detail would help."
    hinted: str = "'{criterion}' is named in the file."
    missing: str = "'{criterion}' was not found in the file for {title}."
    advice: str = "Name projects, certificates or results that show '{criterion}'."
    roles: Mapping[str, str] = None  # type: ignore[assignment]
    decisions: Mapping[str, str] = None  # type: ignore[assignment]
    nobody: str = "the reviewers"

    def role(self) -> Mapping[str, str]:
        return self.roles or {"recruiter": "Recruiter", "hiring_manager": "Hiring Manager"}

    def decision(self) -> Mapping[str, str]:
        return self.decisions or {"advance": "Goes on: {reviewers} found the main criteria for {title} met.", "needs_info": "Open: {reviewers} ask for more about {title}.", "not_selected": "Not chosen for {title} by {reviewers}.", "": "Waits for a review."}


def _fill(template: Column | str, **values: Column) -> Column:
    out = F.lit(template) if isinstance(template, str) else template
    for name, v in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(v.cast("string"), F.lit("")))
    return out


def candidate_feedback(candidates: DataFrame, jobs: DataFrame, evidence: DataFrame, reviews: DataFrame, words: FeedbackWords = FeedbackWords(), default_title: str = "Position") -> DataFrame:
    """Per candidate: candidate_id, job_title, label, strengths (matched and partial, explained), growth_areas (unknown, with advice), decision_summary, email.

    Both lists are by weight and criterion. The summary names the reviewers (with role, newest first) and quotes the newest note.
    """
    c = scored(candidates).select(F.col("id").alias("candidate_id"), "job_id", F.lower("status").alias("status")).distinct()
    j = jobs.select(F.col("id").alias("job_id"), "title").distinct()
    all_ = c.join(j, "job_id", "left").join(evidence_lists(evidence), "candidate_id", "left").join(review_history(reviews), "candidate_id", "left")
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit(default_title))
    base = all_.select("candidate_id", title.alias("job_title"), F.upper(F.right("candidate_id", F.lit(4))).alias("label"), "status", F.coalesce("evidence", F.array()).alias("evidence"), F.coalesce("reviews", F.array()).alias("reviews"))
    kinds = [("matched", True, words.strong), ("matched", False, words.named), ("partial", True, words.partly), ("partial", False, words.hinted)]

    def explain(e: Column) -> Column:
        out = F.lit(None).cast("string")
        for result, quoted, template in kinds:
            test = (e["result"] == result) & ((e["snippet"] != "") if quoted else (e["snippet"] == ""))
            out = F.when(test, _fill(template, criterion=e["criterion"], title=F.col("job_title"), snippet=e["snippet"])).otherwise(out)
        return e.withField("explanation", out)

    def advise(e: Column) -> Column:
        return e.withField("explanation", _fill(words.missing, criterion=e["criterion"], title=F.col("job_title"))).withField("recommendation", _fill(words.advice, criterion=e["criterion"]))

    roles = F.create_map(*[F.lit(x) for pair in words.role().items() for x in pair])
    person = lambda r: F.concat(r["reviewer"], F.coalesce(F.concat(F.lit(" ("), F.coalesce(roles[r["role"]], F.nullif(r["role"], F.lit(""))), F.lit(")")), F.lit("")))
    people = F.array_join(F.transform(F.filter("reviews", lambda r: F.coalesce(r["reviewer"], F.lit("")) != ""), person), ", ")
    note = F.try_element_at(F.filter(F.transform("reviews", lambda r: r["note"]), lambda n: n != ""), F.lit(1))
    decision = F.create_map(*[F.lit(x) for pair in words.decision().items() for x in pair])
    summary = _fill(F.coalesce(decision[F.col("status")], decision[F.lit("")]), reviewers=F.coalesce(F.nullif(people, F.lit("")), F.lit(words.nobody)), title=F.col("job_title"))
    out = base.select(
        "candidate_id", "job_title", "label", F.transform(F.filter("evidence", lambda e: e["result"].isin("matched", "partial")), explain).alias("strengths"),
        F.transform(F.filter("evidence", lambda e: e["result"] == "unknown"), advise).alias("growth_areas"), F.concat(summary, F.coalesce(F.concat(F.lit(" Note: "), note), F.lit(""))).alias("decision_summary"),
    )
    bullets = lambda c, field, n: F.array_join(F.transform(F.slice(c, 1, n), lambda e: F.concat(F.lit("- "), e[field])), "\n")
    email = F.concat_ws("\n\n", F.concat(F.lit("Feedback: "), "job_title", F.lit(" / "), "label"), "decision_summary", bullets("strengths", "explanation", 4), bullets("growth_areas", "recommendation", 3))
    return out.withColumn("email", email)


def dossier(candidates: DataFrame, jobs: DataFrame, criteria: DataFrame, evidence: DataFrame, reviews: DataFrame, top: int = 5) -> DataFrame:
    """The matrix of a job's dossier: job_id, candidate_id, rank, position, label, result, snippet for every chosen candidate and criterion.

    Chosen are all with status advance, else the first ``top`` by score. A criterion takes the evidence of its id, else of its label
    (without regard to case), else ``unknown``. ``criteria`` has job_id, position, id, label.
    """
    c = scored(candidates).where("job_id is not null")
    ahead = c.where("status = 'advance'").select("job_id").distinct().withColumn("any", F.lit(True))
    w = Window.partitionBy("job_id").orderBy(F.col("score").desc_nulls_last(), F.col("at").asc_nulls_last(), F.col("id"))
    first = c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).join(ahead, "job_id", "left_anti").select("job_id", F.col("id").alias("candidate_id"), "score", "at")
    chosen = c.where("status = 'advance'").select("job_id", F.col("id").alias("candidate_id"), "score", "at").unionByName(first)
    cells = chosen.join(criteria.select("job_id", "position", F.col("id").alias("cid"), "label").distinct(), "job_id")
    e = evidence.select("candidate_id", "criterion_id", F.lower(F.trim("criterion")).alias("name"), "id", "result", "snippet").distinct()
    pick = F.min_by(F.struct("result", "snippet"), F.col("id"))
    by_id = e.groupBy("candidate_id", F.col("criterion_id").alias("cid")).agg(pick.alias("x"))
    by_name = e.groupBy("candidate_id", "name").agg(pick.alias("y"))
    out = cells.withColumn("name", F.lower(F.trim("label"))).join(by_id, ["candidate_id", "cid"], "left").join(by_name, ["candidate_id", "name"], "left")
    return out.select("job_id", "candidate_id", "score", "position", "label", F.coalesce("x.result", "y.result", F.lit("unknown")).alias("result"), F.coalesce("x.snippet", "y.snippet", F.lit("")).alias("snippet"))


def criterion_stats(criteria: DataFrame, evidence: DataFrame, candidates: DataFrame) -> DataFrame:
    """Health of every criterion that a job states, also those without evidence: job_id, position, label, matched, partial, unknown, denominator, shares, flag.

    Counts are those of the criterion's id, else of its label; the denominator is what was evaluated, else the job's candidates. ``criteria``
    has job_id, position, id, label.
    """
    from corvane.operators.analytics import evidence_of_jobs, percent

    e = evidence_of_jobs(evidence, candidates)
    counts = [F.count_if(F.col("result") == r).alias(r) for r in ("matched", "partial", "unknown")]
    by_id = e.groupBy("job_id", F.col("criterion_id").alias("cid")).agg(F.struct(*counts).alias("x"))
    by_name = e.groupBy("job_id", F.lower(F.trim("criterion")).alias("name")).agg(F.struct(*counts).alias("y"))
    n = candidates.select("id", "job_id").distinct().groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))
    c = criteria.select("job_id", "position", F.col("id").alias("cid"), "label", F.lower(F.trim("label")).alias("name")).distinct()
    j = c.join(by_id, ["job_id", "cid"], "left").join(by_name, ["job_id", "name"], "left").join(n, "job_id", "left")
    z = j.select("job_id", "position", "label", F.coalesce("n", F.lit(0)).alias("n"), *[F.coalesce(f"x.{r}", f"y.{r}", F.lit(0)).alias(r) for r in ("matched", "partial", "unknown")])
    seen = F.col("matched") + F.col("partial") + F.col("unknown")
    z = z.withColumn("denominator", F.when(seen > 0, seen).otherwise(F.col("n"))).drop("n")
    z = z.select("*", *[percent(F.col(r), F.col("denominator")).alias(f"{r}_pct") for r in ("matched", "partial", "unknown")])
    return z.withColumn("flag", F.when(F.col("unknown_pct") > 80, "bottleneck").when(F.col("matched_pct") > 90, "too_common").otherwise("healthy"))


def profiles(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", skills: Sequence[str] = X.LIVE_SKILLS) -> DataFrame:
    """The live profile of each text: ``keep``, skills not denied, experience (years, text), education as written."""
    clean = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__t")).select(*keep, "__t", T.without_sensitive_lines(F.col("__t")).alias("__p"))
    found = clean.select(*keep, T.live_skills(F.col("__p"), skills).alias("skills"), T.duration_mention(F.col("__p")).alias("d"), T.education_mentions(F.col("__t")).alias("education"))
    return found.select(*keep, "skills", F.col("d.years").alias("experience_years"), F.col("d.text").alias("experience_text"), "education")


@dataclass
class Ingest:
    candidates: DataFrame
    evidence: DataFrame
    audit: DataFrame


def ingest(docs: DataFrame, criteria: Sequence[Criterion], job_id: str, known: DataFrame | None = None, ident: str = "doc_id", text: str = "text", file_type: str = "file_type", at: str = "received_at") -> Ingest:
    """Candidates, evidence and audit rows of new documents, from one match that is stored once.

    Ids follow from the source key, so a retry gives the same rows; documents whose ids are in ``known`` (a table of candidates) are left out.
    A document without any line gives no candidate.
    """
    key = F.concat(F.lit("cand_"), F.substring(F.sha2(F.concat_ws(":", F.lit(job_id), F.col(ident).cast("string")), 256), 1, 12))
    new = docs.select(key.alias("candidate_id"), F.col(text).alias("text"), F.col(file_type).alias("file_type"), F.date_format(F.col(at), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"))
    if known is not None:
        new = new.join(known.select(F.col("id").alias("candidate_id")).distinct(), "candidate_id", "left_anti")
    keep = ("candidate_id", "file_type", "created_at")
    hits = store(match_documents(new, criteria, keep, "text", "live"), "matches")
    facts = profiles(new, ("candidate_id",))
    total = score(hits).select("candidate_id", F.round("score", 1).alias("score"))
    c = hits.select(*keep).distinct().join(total, "candidate_id").join(facts, "candidate_id")
    profile = F.to_json(F.struct("skills", F.col("experience_years").alias("experience_years_mentioned"), F.col("experience_text").alias("experience_duration_text"), F.col("education").alias("education_levels_mentioned")))
    people = c.select(F.col("candidate_id").alias("id"), F.lit(job_id).alias("job_id"), "file_type", profile.alias("profile_json"), "score", F.lit("needs_review").alias("status"), "created_at")
    ev = hits.select(
        F.concat(F.lit("ev_"), F.substring(F.sha2(F.concat_ws(":", "candidate_id", "criterion_id"), 256), 1, 12)).alias("id"), "candidate_id", "criterion_id", "criterion", F.col("type").alias("requirement_type"), "weight", "result", "confidence", "snippet", F.lit(None).cast("int").alias("page_number")
    )
    details = F.to_json(F.struct("file_type", F.lit(len(criteria)).alias("evidence_count"), "score"))
    log = c.select(F.concat(F.lit("evt_"), F.substring(F.sha2(F.concat_ws(":", F.lit("candidate_parsed"), "candidate_id"), 256), 1, 12)).alias("id"), F.lit(job_id).alias("job_id"), "candidate_id", F.lit("system").alias("actor"), F.lit("candidate_parsed").alias("event_type"), details.alias("details_json"), "created_at")
    return Ingest(people, ev, log)


def hiring_summary(candidates: DataFrame, reviews: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per job with a struct for each of funnel, agreement, grounding, ranking and leaks."""
    from corvane.operators import analytics as A

    funnel = A.job_funnel(candidates).groupBy("job_id").agg(F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("funnel"))  # one row per status
    row = lambda df, name: df.select("job_id", F.struct(*[c for c in df.columns if c != "job_id"]).alias(name))
    q = A.ranking_quality(A.relevance(candidates, reviews), 10)
    parts = [row(A.agreement(reviews, candidates), "agreement"), row(A.grounding_audit(evidence, candidates), "grounding"), row(q, "ranking"), row(A.pii_audit(evidence, candidates), "leaks")]
    out = funnel.where("job_id is not null")
    for p in parts:
        out = out.join(p, "job_id", "left")
    return out
