"""Criteria against lines of text: the first line that holds a criterion decides, with a traceable place.

Criteria come as data. Their patterns are literals of the plan (a handful per job), so the engine
compiles each once. A document stays one row: its lines are an array, and each criterion looks for its first line
there, so nothing is shuffled. Lines are normalised once, and only where a document holds a criterion's words at all.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from math import ceil
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import fixed as X
from corvane.functions import text as T
from corvane.functions.instants import instant


@dataclass(frozen=True)
class Criterion:
    id: str
    label: str
    type: str = "required"
    weight: float = 1.0
    aliases: tuple[str, ...] = ()

    def terms(self, profile: str = "taxonomy") -> tuple[str, ...]:
        """The label and its aliases, each once; ``taxonomy`` adds the label's parts between / | & ( ), ``live`` the fixed aliases of the label."""
        label = " ".join(self.label.lower().split())
        parts = [self.label]
        if profile == "live":
            for key, other in X.LIVE_ALIASES.items():
                if label == key or label in other:
                    parts += other
        else:
            for sep in "/|&()":
                parts = [x for p in parts for x in p.split(sep)]
        return tuple(dict.fromkeys(x.strip().lower() for x in (self.label, *parts, *self.aliases) if len(x.strip()) > 1))

    @property
    def tokens(self) -> tuple[str, ...]:
        """The words of the label, repeated ones as often as they stand there."""
        return tuple(t for t in re.findall(r"[a-z0-9+#.]+", self.label.lower()) if len(t) > 1)

    @property
    def enough(self) -> int:
        """How many of the words a line needs to match in part; none can if there are fewer than two."""
        return max(2, ceil(len(self.tokens) / 2))


def document_lines(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per non-blank line: ``ident``, line_no (from 0), line."""
    return docs.select(F.col(ident), F.posexplode(T.lines(F.col(text))).alias("line_no", "line"))


def match_criteria(lines: DataFrame, criteria: Sequence[Criterion], ident: str = "doc_id", profile: str = "taxonomy") -> DataFrame:
    """``match_documents`` for documents given as rows of ``ident``, line_no and line."""
    docs = lines.groupBy(ident).agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("__lines"))
    return _match(docs, criteria, [ident], profile)


def match_documents(docs: DataFrame, criteria: Sequence[Criterion], keep: Sequence[str] = ("doc_id",), text: str = "text", profile: str = "taxonomy") -> DataFrame:
    """One row per document with a line and criterion: ``keep``, the criterion, result, confidence, line_no and redacted snippet of the deciding line.

    ``taxonomy``: a line with an alias is a match; else one with at least two (and half) of the label's
    tokens is partial; the first line of the better class decides. ``live`` adds: a denied mention on any line
    makes the criterion ``needs_verification``, as does a hit whose snippet is redacted away. A document without lines has no rows.
    """
    return _match(docs.select(*[F.col(c) for c in keep], T.lines(F.col(text)).alias("__lines")), criteria, keep, profile)


def _match(docs: DataFrame, criteria: Sequence[Criterion], keep: Sequence[str], profile: str) -> DataFrame:
    longest = lambda term: F.lit(max(term.split(), key=len))
    terms = {c.id: c.terms(profile) for c in criteria}
    every = docs.withColumn("__all", F.replace(F.translate(F.lower(F.array_join("__lines", "\n")), "–—", "--"), F.lit("ß"), F.lit("ss")))

    def possible(c: Criterion) -> Column:
        """Whether the words are there at all, in whatever line."""
        exact = [F.contains(F.col("__all"), longest(t)) for t in terms[c.id]]
        out = exact[0]
        for x in exact[1:]:
            out = out | x
        if len(c.tokens) > 1:
            out = out | (sum((F.contains(F.col("__all"), F.lit(t)).cast("int") for t in c.tokens), F.lit(0)) >= c.enough)
        return out

    flags = every.select(*keep, "__lines", "__all", F.array(*[possible(c) for c in criteria]).alias("__may"))
    # lower case and plain dashes were made of the whole text at once, which is cheaper than line by line
    low = F.when(F.exists("__may", lambda x: x), F.transform(F.split("__all", "\n"), lambda x: F.trim(T.collapse_blanks(x)))).otherwise(F.array().cast("array<string>"))
    ready = flags.select(*keep, "__lines", "__may", low.alias("__low"))
    none = F.array(*[F.lit(0).cast("bigint")] * 3)

    def places(c: Criterion) -> Column:
        """Numbers (from 1, 0: none) of the first denied line (``live``), the first match and the first partial one."""
        first = lambda test: F.array_position(F.transform("__low", test), F.lit(True))
        holds = lambda x: reduce(or_, [T.holds(x, t) for t in terms[c.id]])
        some = lambda x, denied: holds(x) & F.exists(T.negated_mentions(x, terms[c.id]), lambda y: y if denied else ~y)
        words = lambda x: sum((T.holds(x, t).cast("int") for t in c.tokens), F.lit(0)) >= c.enough
        part = first(lambda x: words(x) & ~holds(x)) if len(c.tokens) > 1 else none[0]
        if profile == "live":
            return F.array(first(lambda x: some(x, True)), first(lambda x: some(x, False)), part)
        return F.array(none[0], first(holds), part)

    placed = ready.select(*keep, "__lines", *[F.when(F.col("__may")[k], places(c)).otherwise(none).alias(f"__at{k}") for k, c in enumerate(criteria)])
    rows = []
    for k, c in enumerate(criteria):
        at = F.col(f"__at{k}")
        grade = F.when(at[0] > 0, 0).when(at[1] > 0, 1).when(at[2] > 0, 2)
        number = (F.get(at, grade) - 1).cast("int")
        focus = F.filter(F.array(*[F.lit(t) for t in dict.fromkeys((*terms[c.id], *c.tokens))]), lambda t: t != "")
        rows.append(F.struct(
            F.lit(c.id).alias("criterion_id"), F.lit(c.label).alias("criterion"), F.lit(c.type).alias("type"), F.lit(float(c.weight)).alias("weight"),
            grade.alias("g"), number.alias("line_no"), F.get("__lines", number).alias("line"), focus.alias("focus"),
        ))
    found = placed.select(*keep, F.explode(F.when(F.size("__lines") > 0, F.array(*rows))).alias("m")).select(*keep, "m.*")
    snippet = T.redact_for_evidence(F.col("line"), profile=profile, focus=F.col("focus") if profile == "live" else None)
    found = found.select(*keep, "criterion_id", "criterion", "type", "weight", "g", "line_no", F.when(F.col("g").isNotNull(), snippet).otherwise("").alias("snippet"))
    hidden = F.col("g").isNotNull() & (F.col("snippet") == "") if profile == "live" else F.lit(False)
    result = F.when((F.col("g") == 0) | hidden, "needs_verification").when(F.col("g") == 1, "matched").when(F.col("g") == 2, "partial").otherwise("unknown")
    out = found.select(*keep, "criterion_id", "criterion", "type", "weight", result.alias("result"), "line_no", "snippet")
    return out.withColumn("confidence", F.when(F.col("result") == "matched", 1.0).when(F.col("result") == "partial", 0.5).otherwise(0.0))


def score_documents(docs: DataFrame, criteria: Sequence[Criterion], keep: Sequence[str] = ("doc_id",), text: str = "text", profile: str = "taxonomy") -> DataFrame:
    """``keep`` and the weighted score in percent of every document with a line."""
    m = match_documents(docs, criteria, keep, text, profile)
    return score(m.select(F.struct(*keep).alias("__k"), "result", "weight"), "__k").select("__k.*", "score", "n_criteria")


def score(evidence: DataFrame, ident: str = "candidate_id") -> DataFrame:
    """Weighted score of each document in percent: 100·Σ(value·weight)/Σweight; a weight sum of 0 counts as 1."""
    value = F.when(F.col("result") == "matched", 1.0).when(F.col("result") == "partial", 0.5).otherwise(0.0)
    total = F.sum("weight")
    return evidence.groupBy(ident).agg(
        (F.lit(100.0) * F.sum(value * F.col("weight")) / F.coalesce(F.nullif(total, F.lit(0.0)), F.lit(1.0))).alias("score"), F.count(F.lit(1)).alias("n_criteria")
    )


def canonical_order(df: DataFrame, ident: str = "id") -> DataFrame:
    """Score descending, created_at ascending as an instant, id ascending."""
    return df.orderBy(F.col("score").desc_nulls_last(), instant(F.col("created_at")).asc_nulls_last(), F.col(ident).asc())
