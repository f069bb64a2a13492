"""BM25 retrieval over chunks as joins: an inverted index meets all queries at once.

Chunks are tokenised and indexed once (term, chunk, frequency). Queries are small: their terms are matched to the index by
an equi-join, scores are sums per (query, chunk), and only chunks that share a term take part.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import STOP_WORDS, normalize, split_sentences, tokenize
from corvane.session import store

K1, B = 1.5, 0.75
# Words by which a question asks for required criteria, or for guides and rubrics.
REQUIRED_SIGNALS = frozenset("wajib required mandatory must".split())
RUBRIC_SIGNALS = frozenset("rubrik wawancara interview pertanyaan panduan skala".split())


def sentence_chunks(docs: DataFrame, ident: str, text: str, source_weight: float = 1.1) -> DataFrame:
    """Sentences of each document as chunks: ``ident``, chunk_no, text, source_weight."""
    return docs.select(F.col(ident), F.posexplode(split_sentences(F.col(text))).alias("chunk_no", "text"), F.lit(source_weight).alias("source_weight"))


def postings(chunks: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """The inverted index: keys, term, tf, length of the chunk in tokens."""
    t = chunks.select(*keys, tokenize(F.col(text), STOP_WORDS).alias("tokens"))
    return t.select(*keys, F.size("tokens").alias("length"), F.explode("tokens").alias("term")).groupBy(*keys, "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def idf(index: DataFrame, n_chunks: int) -> DataFrame:
    """ln(1 + (N - df + 0.5)/(df + 0.5)) of every term."""
    df = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.select("term", "df", F.log1p((F.lit(n_chunks) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def bm25(index: DataFrame, queries: DataFrame, keys: Sequence[str], n_chunks: int, mean_length: float, technical: Sequence[str] = (), k: int = 10) -> DataFrame:
    """The ``k`` best chunks of each query (query_id, text): score, matched terms, rank; ties by the keys.

    Technical terms weigh double and add 1.5 each, as exact words count more than prose.
    """
    q = queries.select("query_id", F.explode(F.array_distinct(tokenize(F.col("text"), STOP_WORDS))).alias("term"))
    # document frequencies are only needed of the queries' terms, and come from the rows the join leaves
    hit = index.join(q, "term")
    terms = hit.select(*keys, "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.log1p((F.lit(n_chunks) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tech = F.col("term").isin(*technical) if technical else F.lit(False)
    part = weight * (F.col("tf") * (K1 + 1)) / (F.col("tf") + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("length") / F.lit(mean_length)))
    part = part * F.when(tech, 2.0).otherwise(1.0) + F.when(tech, 1.5).otherwise(0.0)
    scored = hit.join(terms, "term").groupBy("query_id", *keys).agg(F.sum(part.cast("decimal(24,12)")).cast("double").alias("score"), F.count(F.lit(1)).alias("matched"))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), *keys)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


@dataclass(frozen=True)
class Query:
    """A question with its tokens (all of them if only stop words are left) and the signals of its intent."""

    id: str
    text: str

    @property
    def normal(self) -> str:
        return " ".join(self.text.lower().replace("ß", "ss").replace("–", "-").replace("—", "-").split())

    @property
    def tokens(self) -> list[str]:
        clean = [re.sub(r"^[/-]+|[./-]+$", "", t) for t in re.findall(r"[a-z0-9+#./-]+", self.normal)]
        every = [t for t in clean if len(t) > 1 or re.match("[cr0-9]$", t)]
        return [t for t in every if t not in STOP_WORDS] or every

    @property
    def intent(self) -> str:
        """The kind of chunk that the question prefers, if any."""
        mine = set(self.tokens)
        return "required_criterion" if mine & REQUIRED_SIGNALS else "interview_rubric" if mine & RUBRIC_SIGNALS else ""


def _literal(q: Query, technical: frozenset[str]) -> Column:
    n, tokens = len(q.tokens), q.tokens
    unique = list(dict.fromkeys(tokens))
    strings = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    return F.struct(
        F.lit(q.id).alias("query_id"), strings(unique).alias("terms"), F.array(*[F.lit(t in technical) for t in unique]).cast("array<boolean>").alias("tech"),
        strings([f"{a} {b}" for a, b in zip(tokens, tokens[1:], strict=False)]).alias("pairs"), F.lit(" ".join(tokens)).alias("phrase"), F.lit(q.normal).alias("normal"), F.lit(n).alias("n"), F.lit(q.intent).alias("intent"),
    )


def job_chunks(jobs: DataFrame, criteria: DataFrame, guides: DataFrame, rubrics: DataFrame, custom: DataFrame | None = None) -> DataFrame:
    """Everything a job's questions may be answered from: job_id, chunk_no (the order of the sources), source_type, label, text, source_weight.

    Title and department (1.2), sentences of the description (1.1), criteria (2.2 or 1.1 times their weight), ``guides`` for every job
    (text, label, source_weight), ``rubrics`` (keyword, text; a null keyword is for every criterion and ``{}`` in it stands for the
    label; 1.6 for required criteria, else 1.2), and sentences of ``custom`` texts (job_id, label, text, source_weight). ``guides`` and
    ``rubrics`` are short lists. ``criteria`` has job_id, position, label, type, weight.
    """
    clean = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    j = jobs.select(F.col("id").alias("job_id"), clean("title").alias("title"), clean("department").alias("department"), clean("description").alias("description")).distinct()
    part = lambda df, rank, at, kind, label, text, weight: df.select(
        "job_id", F.struct(F.lit(rank).alias("a"), at.cast("int").alias("b"), F.lit(0).alias("c")).alias("chunk_no"), F.lit(kind).alias("source_type") if isinstance(kind, str) else kind.alias("source_type"), label.alias("label"), text.alias("text"), weight.cast("double").alias("source_weight")
    )
    zero = F.lit(0)
    meta = part(j.where("title <> ''"), 0, zero, "position_meta", F.col("title"), F.concat(F.lit("Position: "), "title", F.when(F.col("department") != "", F.concat(F.lit(" | Department: "), "department")).otherwise("")), F.lit(1.2))
    lines = j.select("job_id", F.posexplode(split_sentences(F.col("description"))).alias("at", "s"))
    told = part(lines, 1, F.col("at"), "job_description", F.lit("Job Description"), F.col("s"), F.lit(1.1))
    c = criteria.select("job_id", "position", F.trim("label").alias("label"), (F.lower(F.coalesce("type", F.lit("required"))) == "required").alias("req"), "weight").where("label <> ''").distinct()
    c = c.withColumn("weight", F.coalesce("weight", F.when(F.col("req"), 2.0).otherwise(1.0)))
    kind = F.when(F.col("req"), "required_criterion").otherwise("preferred_criterion")
    stated = part(c, 2, F.col("position"), kind, F.col("label"), F.concat(F.when(F.col("req"), "required").otherwise("preferred"), F.lit(" criterion: "), "label", F.lit(" (weight "), F.format_string("%.1f", "weight"), F.lit(")")), F.col("weight") * F.when(F.col("req"), 2.2).otherwise(1.1))
    rules = part(j.select("job_id").crossJoin(F.broadcast(guides)), 3, F.col("no"), "interview_rubric", F.col("label"), F.col("text"), F.col("source_weight"))  # a short list for every job
    fitting = F.col("keyword").isNull() | F.contains(F.lower("label"), F.lower("keyword"))
    r = c.crossJoin(F.broadcast(rubrics.withColumnRenamed("text", "rubric"))).where(fitting)  # a short list for every criterion
    asked = part(r, 4, F.col("position") * 100 + F.col("no"), "interview_rubric", F.col("label"), F.replace(F.col("rubric"), F.lit("{}"), F.col("label")), F.when(F.col("req"), 1.6).otherwise(1.2))
    out = meta.unionByName(told).unionByName(stated).unionByName(rules).unionByName(asked)
    if custom is not None:
        own = custom.select("job_id", "label", "source_weight", F.posexplode(split_sentences(F.col("text"))).alias("at", "text"))
        out = out.unionByName(part(own, 5, F.col("at"), "custom_knowledge", F.col("label"), F.col("text"), F.coalesce("source_weight", F.lit(1.0))))
    return out


def retrieve(chunks: DataFrame, queries: Sequence[Query], technical: Sequence[str] = (), k: int = 5) -> DataFrame:
    """The ``k`` best chunks of every job for each question: job_id, query_id, rank, source_type, label, text, score, matched.

    BM25 over the job's own chunks, a term that only stands within a longer word counting once; technical terms weigh double and add 1.5 each;
    a whole phrase adds 4 (as typed: 3.5) a word, else a pair of words 1.8; a term in the label 2.5; all times the source's weight and, for the kind of chunk that the
    question prefers, 1.8. Chunks of the same letters count once. The questions are a stated list; a question without tokens finds nothing.
    """
    asked = [q for q in queries if q.tokens]
    terms = sorted({t for q in asked for t in q.tokens})
    if not asked:
        return chunks.sparkSession.createDataFrame([], "job_id string, query_id string, rank int, source_type string, label string, text string, score double, matched array<string>")
    prepared = chunks.select("*", tokenize(F.col("text"), STOP_WORDS).alias("tokens"), normalize(F.col("text")).alias("norm"), normalize(F.col("label")).alias("tag"))
    prepared = store(prepared, "chunks")  # read twice: for the counts and for the scores
    stats = prepared.groupBy("job_id").agg(F.count(F.lit(1)).alias("chunks"), F.avg(F.size("tokens")).alias("mean"), *[F.count_if(F.array_contains("tokens", t)).alias(f"df{i}") for i, t in enumerate(terms)])
    table = F.map_from_arrays(F.array(*[F.lit(t) for t in terms]), F.array(*[F.col(f"df{i}") for i in range(len(terms))]))
    stats = stats.select("job_id", "chunks", F.greatest("mean", F.lit(1.0)).alias("mean"), table.alias("df"))
    tech = frozenset(technical)
    rows = prepared.join(stats, "job_id").select("*", F.explode(F.array(*[_literal(q, tech) for q in asked])).alias("q"))
    rows = rows.select("job_id", "chunk_no", "source_type", "label", "text", "source_weight", "tokens", "norm", "tag", "chunks", "mean", "df", "q.*")
    tf = lambda t: F.size(F.filter("tokens", lambda x: x == t))
    count = lambda t: F.when(tf(t) > 0, tf(t)).when(F.contains(F.col("norm"), t), 1).otherwise(0)
    size = F.size("tokens")

    def part(t: Column, technical: Column) -> Column:
        idf = F.log1p((F.col("chunks") - F.col("df")[t] + 0.5) / (F.col("df")[t] + 0.5))
        n = count(t)
        return idf * (n * (K1 + 1)) / (n + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * size / F.col("mean"))) * F.when(technical, 2.0).otherwise(1.0)

    found = lambda t: F.array_contains("tokens", t) | ((F.length(t) >= 3) & F.contains(F.col("norm"), t))
    base = F.aggregate(F.zip_with("terms", "tech", part), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    matched = F.filter("terms", found)
    bonus = F.size(F.filter(F.zip_with("terms", "tech", lambda t, h: h & found(t)), lambda x: x)) * 1.5
    within = lambda x: F.contains(F.col("norm"), x)
    phrase = F.when(F.col("n") < 2, 0.0).when(within(F.col("phrase")), F.col("n") * 4.0).when(within(F.col("normal")), F.col("n") * 3.5).otherwise(F.size(F.filter("pairs", within)) * 1.8)
    named = F.when(F.exists("terms", lambda t: (t == F.col("tag")) | F.array_contains(F.split("tag", " "), t)), 2.5).otherwise(0.0)
    boost = F.when(F.col("intent") == F.col("source_type"), 1.8).otherwise(1.0)
    scored = rows.select("job_id", "query_id", "chunk_no", "source_type", "label", "text", matched.alias("matched"), ((base + bonus + phrase + named) * F.col("source_weight") * boost).alias("raw"))
    hits = scored.where((F.size("matched") > 0) & (F.col("raw") > 0.01)).withColumn("score", F.round("raw", 4))
    order = [F.col("score").desc(), F.col("chunk_no").asc(), F.col("text").asc()]
    letters = F.regexp_replace(F.lower("text"), r"(?U)\W+", "")
    once = hits.withColumn("d", F.row_number().over(Window.partitionBy("job_id", "query_id", letters).orderBy(*order))).where("d = 1")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("job_id", "query_id").orderBy(*order))).where(F.col("rank") <= k).select("job_id", "query_id", "rank", "source_type", "label", "text", "score", "matched")


def overlap_rank(chunks: DataFrame, queries: DataFrame, keys: Sequence[str], k: int = 5) -> DataFrame:
    """Fallback ranking: the number of distinct query words that a chunk shares."""
    c = chunks.select(*keys, F.explode(F.array_distinct(tokenize(F.col("text"), STOP_WORDS))).alias("term"))
    q = queries.select("query_id", F.explode(F.array_distinct(tokenize(F.col("text"), STOP_WORDS))).alias("term"))
    n = c.join(q, "term").groupBy("query_id", *keys).agg(F.count(F.lit(1)).alias("overlap"))
    w = Window.partitionBy("query_id").orderBy(F.desc("overlap"), *keys)
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
