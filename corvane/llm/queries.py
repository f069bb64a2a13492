"""Queries of the operators in this package, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.instants import instant, key_text
from corvane.llm.bpe import token_counts, token_ids
from corvane.llm.consensus import Consensus, clean_label, consensus, krippendorff_alpha
from corvane.llm.languages import Model, identify, language_tag, train
from corvane.llm.packing import fill_report, pack
from corvane.llm.personal import accept, extract, find, learn, redacted
from corvane.llm.splitting import split_oversized
from corvane.llm.topn import top_n
from corvane.session import cut, spread, table

CAPACITY = 2048  # tokens a container holds
LIMIT, OVERLAP = 512, 64  # tokens of a piece, tokens shared with the one before


def _model(spark: SparkSession, d: str) -> Model:
    return train(table(spark, d, "documents"), "text", "lang", "doc_id")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    model = _model(spark, d)
    docs = identify(spread(table(spark, d, "documents")).withColumn("tag", language_tag(F.col("lang"))), model, "text", ["doc_id", "tag"])
    several = F.size("languages") > 1
    wrong = F.col("tag").isNull() | (F.col("tag") != F.get("languages", F.lit(0))["lang"])
    held = F.explode("languages").alias("x")
    cases = docs.where((F.size("languages") > 0) & (several | wrong)).select(F.lit("documents").alias("src_table"), F.col("doc_id").cast("string").alias("row_id"), held)

    # one pass over the snippets serves both the mixed ones and the language of each CV
    snippets = cut(identify(spread(table(spark, d, "evidence").select("id", "candidate_id", "snippet")), model, "snippet", ["id", "candidate_id"]))
    mixed = snippets.where(several).select(F.lit("evidence").alias("src_table"), F.col("id").alias("row_id"), held)
    labels = _annotated(spark, d, snippets).where(F.col("lang").isNotNull() & (F.col("tag").isNull() | (F.col("tag") != F.col("lang"))))
    out = cases.unionByName(mixed).select("src_table", "row_id", F.col("x.lang").alias("lang"))
    return out.unionByName(labels.select(F.lit("annotations").alias("src_table"), F.concat_ws(":", "candidate_id", "criterion_id").alias("row_id"), "lang")).distinct()


def _annotated(spark: SparkSession, d: str, snippets: DataFrame) -> DataFrame:
    """Every annotation row with its label's code, and the language of the candidate's snippets taken together, which is null where they hold none."""
    per = snippets.select(key_text(F.col("candidate_id")).alias("key"), F.explode("languages").alias("x"))
    weight = per.groupBy("key", F.col("x.lang").alias("lang")).agg(F.sum("x.chars").alias("chars"), F.sum(F.col("x.chars") * F.col("x.confidence")).alias("sure"))
    main = weight.groupBy("key").agg(F.max_by(F.struct("lang", (F.col("sure") / F.col("chars")).alias("confidence")), F.struct("chars", "lang")).alias("m"))
    rows = table(spark, d, "annotations").select(key_text(F.col("candidate_id")).alias("key"), "candidate_id", "criterion_id", "cv_language", language_tag(F.col("cv_language")).alias("tag")).distinct()
    return rows.join(main, "key", "left").select("candidate_id", "criterion_id", "cv_language", "tag", "m.lang", "m.confidence")


def p1_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its languages: one row per segment, with the document's language and confidence."""
    return _segments(identify(spread(table(spark, d, "documents")), _model(spark, d), "text", ["doc_id"], segments=True), "doc_id")


def _segments(texts: DataFrame, ident: str) -> DataFrame:
    first = F.get("languages", F.lit(0))
    rows = texts.select(ident, first["lang"].alias("lang"), first["confidence"].alias("confidence"), F.posexplode_outer("segments").alias("segment", "s"))
    return rows.select(
        ident, "lang", "confidence", "segment", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.lang").alias("segment_lang"), F.col("s.confidence").alias("segment_confidence")
    )


def p1_snippets(spark: SparkSession, d: str) -> DataFrame:
    """Every snippet with its languages, as ``p1_segments`` has the documents."""
    return _segments(identify(table(spark, d, "evidence").select("id", "snippet").distinct(), _model(spark, d), "snippet", ["id"], segments=True), "id")


def p1_annotations(spark: SparkSession, d: str) -> DataFrame:
    """Every annotation row with the language of its CV (of its candidate's snippets) and the confidence, both null where they hold none."""
    snippets = identify(spread(table(spark, d, "evidence").select("id", "candidate_id", "snippet")), _model(spark, d), "snippet", ["id", "candidate_id"])
    return _annotated(spark, d, snippets).select("candidate_id", "criterion_id", "cv_language", "lang", "confidence")


def _top(spark: SparkSession, d: str, n: int) -> DataFrame:
    rows = table(spark, d, "candidates").select("job_id", "score", instant(F.col("created_at")).alias("at"), "id")
    return top_n(rows, "job_id", "score", "at", "id", n)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d, 5).select("job_id", F.col("id").alias("candidate_id")).distinct()


def p2_top50(spark: SparkSession, d: str) -> DataFrame:
    """The 50 first of every job with score and place."""
    return _top(spark, d, 50).select("job_id", F.col("id").alias("candidate_id"), "score", "position")


NOTES = (("evidence", "snippet"), ("reviews", "note"), ("interview_scorecards", "notes"), ("interview_criterion_scores", "evidence_notes"))


def _notes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The texts of the four fields (src_table, row_id, text), and what is accepted in them with the reviewers as known people."""
    parts = [table(spark, d, t).select(F.lit(t).alias("src_table"), F.col("id").alias("row_id"), F.col(c).alias("text")) for t, c in NOTES]
    texts = reduce(DataFrame.unionByName, parts)
    people = table(spark, d, "reviews").select("reviewer").unionByName(table(spark, d, "interview_scorecards").select("reviewer")).distinct()
    corpus = extract(texts, "text")
    return texts, accept(corpus, learn(corpus, people))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    texts, hits = _notes(spark, d)
    return find(texts, "text", ["src_table", "row_id"], hits).distinct()


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The four fields with typed placeholders."""
    texts, hits = _notes(spark, d)
    return redacted(texts, "text", hits)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return token_ids(spread(table(spark, d, "documents").select("doc_id", "text")))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return pack(token_counts(spread(docs.select("doc_id", "text"))), CAPACITY, items=docs.count())


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of ``p8_containers`` are."""
    return fill_report(p8_containers(spark, d), CAPACITY)


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(spread(table(spark, d, "documents").select("doc_id", "text")), LIMIT, OVERLAP)


LABELS = ("supported", "partial", "no_evidence", "needs_verification")
ITEM = ("candidate_id", "criterion_id")


def _people(spark: SparkSession, d: str) -> DataFrame:
    """Single people's labels: item, role, annotator, label. Copies are not dropped."""
    packets = table(spark, d, "annotation_packets")
    return packets.select(*ITEM, "reviewer_role", "annotator", clean_label(F.col("reviewer_label"), LABELS).alias("label")).dropna()


def _votes(spark: SparkSession, d: str) -> DataFrame:
    """All votes: people, adjudicators and the matcher each by their own name; the role columns of
    ``annotations`` repeat a person's label and count only where no label of that role is known."""
    people, rows = _people(spark, d), table(spark, d, "annotations")
    matched = F.create_map(*[F.lit(x) for x in ("matched", "supported", "partial", "partial", "unknown", "no_evidence", "needs_verification", "needs_verification")])
    vote = lambda who, label: F.struct(F.lit(who).alias("annotator"), label.alias("label"))
    own = [vote("@adjudicator", clean_label(F.col("adjudicated_label"), LABELS)), vote("@matcher", matched[F.lower(F.trim("model_result"))])]
    out = people.select(*ITEM, "annotator", "label").unionByName(rows.select(*ITEM, F.inline(F.array(*own))))
    roles = F.array(*[F.struct(F.lit(r).alias("reviewer_role"), clean_label(F.col(f"{r}_label"), LABELS).alias("label")) for r in ("recruiter", "hiring_manager")])
    single = rows.select(*ITEM, F.inline(roles)).where("label is not null").join(people, [*ITEM, "reviewer_role"], "left_anti")
    return out.unionByName(single.select(*ITEM, F.concat(F.lit("@"), "reviewer_role").alias("annotator"), "label"))


def _consensus(spark: SparkSession, d: str) -> Consensus:
    return consensus(_votes(spark, d), LABELS, ITEM, items=table(spark, d, "annotations"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _consensus(spark, d).items.select(*ITEM, "label")


def p3_annotators(spark: SparkSession, d: str) -> DataFrame:
    """Reliability of every annotator with its interval and confusion rows."""
    return _consensus(spark, d).annotators


def p3_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Krippendorff's alpha of the people's labels."""
    return krippendorff_alpha(_people(spark, d).distinct(), ITEM).select(F.round("alpha", 9).alias("alpha"), "n_items", "n_votes")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_segments": p1_segments,
    "p1_snippets": p1_snippets,
    "p1_annotations": p1_annotations,
    "p2_found": p2_found,
    "p2_top50": p2_top50,
    "p3_found": p3_found,
    "p3_annotators": p3_annotators,
    "p3_agreement": p3_agreement,
    "p4_found": p4_found,
    "p4_redacted": p4_redacted,
    "p7_ids": p7_ids,
    "p8_containers": p8_containers,
    "p8_fill": p8_fill,
    "p9_pieces": p9_pieces,
}

_RANKED = r"""
WITH r AS (
  SELECT DISTINCT job_id, id, score, TRY_CAST(CASE WHEN regexp_matches(trim(created_at), '(Z|[+-]\d\d:\d\d)$') THEN trim(created_at) ELSE trim(created_at) || '+00:00' END AS TIMESTAMPTZ) t
  FROM candidates WHERE job_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)),
p AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, t ASC NULLS LAST, id ASC NULLS LAST) "position" FROM r)
"""

ORACLES: dict[str, str] = {
    "p2_found": _RANKED + 'SELECT job_id, id candidate_id FROM p WHERE "position" <= 5',
    "p2_top50": _RANKED + 'SELECT job_id, id candidate_id, score, CAST("position" AS INT) "position" FROM p WHERE "position" <= 50',
    "p3_agreement": r"""
WITH v AS (SELECT DISTINCT candidate_id, criterion_id, reviewer_role, annotator, regexp_replace(lower(trim(reviewer_label)), '[ _-]+', '_', 'g') l FROM annotation_packets),
c AS (SELECT candidate_id, criterion_id, l, count(*) n FROM v WHERE l IN ('supported', 'partial', 'no_evidence', 'needs_verification') GROUP BY ALL),
u AS (SELECT candidate_id, criterion_id, sum(n) m, sum(n * n) sq FROM c GROUP BY ALL HAVING sum(n) > 1),
t AS (SELECT sum((m * m - sq) / (m - 1)) o, sum(m) n, count(*) k FROM u),
e AS (SELECT sum(x * x) s FROM (SELECT l, sum(n) x FROM c SEMI JOIN u USING (candidate_id, criterion_id) GROUP BY l))
SELECT round(1 - (n - 1) * o / (n * n - s), 9) alpha, k n_items, CAST(n AS BIGINT) n_votes FROM t, e""",
}
