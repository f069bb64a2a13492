"""A consensus label per item from labels of several people, by a variational confusion model.

Every item has a hidden class; every annotator has, per class, a distribution over labels. Both the
class shares and the annotators' rows have Dirichlet priors, and mean-field updates alternate:
expected log probabilities (digammas of counts) sum up per item to its class probabilities, and
these sum up per (annotator, label) to the counts. Both steps are group-bys; the counts alone go from
one round to the next.

The votes are grouped by item once. A vote is the number of its (annotator, label) pair, so an item's
votes are no more than there are pairs, and where the pairs are few enough to be broadcast each round reads the
items in place and shuffles only partial counts. With more pairs the votes stay rows that meet the counts in joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import cut, store

PAIRS = 50_000  # (annotator, label) pairs whose counts may be broadcast; beyond, they are joined


def _digamma(x, ln: Callable):
    """The digamma function for positive ``x``: recurrence up to x + 6, then its asymptotic series."""
    y = x + 6.0
    inv2 = 1.0 / (y * y)
    series = ln(y) - 0.5 / y - inv2 * (1 / 12 - inv2 * (1 / 120 - inv2 * (1 / 252 - inv2 * (1 / 240))))
    for k in range(6):
        series = series - 1.0 / (x + float(k))
    return series


def digamma(x: Column) -> Column:
    """The digamma function for positive ``x``."""
    return _digamma(x, F.ln)


def clean_label(text: Column, labels: Sequence[str]) -> Column:
    """One of ``labels`` whatever its case, outer space and separators; null for anything else."""
    t = F.regexp_replace(F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " "))), r"[ _-]+", "_")
    return F.when(t.isin(*labels), t)


@dataclass
class Consensus:
    """``items``: item columns, label, probability, p_<label>, n_votes; ``annotators``: annotator,
    reliability, low, high, n_votes and the mean confusion row of each class as c_<class>_<label>;
    ``rounds`` that were run, and whether the counts had ``converged`` by then."""

    items: DataFrame
    annotators: DataFrame
    rounds: int
    converged: bool


@dataclass
class _Prior:
    labels: Sequence[str]
    diagonal: float
    other: float
    share: float

    @property
    def row(self) -> float:
        return self.diagonal + (len(self.labels) - 1) * self.other

    def of(self, m: int, label: str) -> float:
        return self.diagonal if self.labels[m] == label else self.other


def consensus(
    votes: DataFrame,
    labels: Sequence[str],
    item: Sequence[str] = ("item",),
    annotator: str = "annotator",
    label: str = "label",
    items: DataFrame | None = None,
    diagonal: float = 4.0,
    other: float = 1.0,
    share: float = 1.0,
    rounds: int = 40,
    tolerance: float = 1e-4,
    pairs: int = PAIRS,
) -> Consensus:
    """Fit the model to ``votes`` and label every item of ``items`` (those with votes, if not given).

    Votes with a null item, annotator or label, or a label outside ``labels``, are none; repeated votes of one
    annotator with one label for one item count once. An item without votes has the most frequent class
    with its share as probability. Ties go to the label that stands first in ``labels``. Without
    any vote the classes are equally likely and there is no annotator. ``diagonal`` and ``other`` are the prior counts
    of right and wrong labels, ``share`` of each class. There are at most ``rounds`` rounds; they end when no
    count moves by more than ``tolerance`` of the largest, and the result says whether that was reached.
    Up to ``pairs`` different (annotator, label) pairs are counted by broadcast, more by joins, with the same result.
    """
    key, k = list(item), len(labels)
    prior = _Prior(labels, diagonal, other, share)
    given = (
        votes.select(*[F.col(c) for c in key], F.col(annotator).alias("__a"), F.col(label).alias("__l"))
        .where(F.col("__l").isin(*labels) & F.col("__a").isNotNull())
        .dropna(subset=key)
    )
    given = store(given, "votes")
    every = items.select(*key).dropna().withColumn("__own", F.lit(True)) if items is not None else None
    known = given.select("__a", "__l").distinct().limit(pairs + 1).collect()
    fit = _fit_joined if len(known) > pairs else _fit_shared
    q, counts, total, done, converged = fit(given, every, key, prior, rounds, tolerance, sorted((r["__a"], r["__l"]) for r in known))

    mean = [(n + share) / (sum(total) + k * share) for n in total]
    p = [F.when(F.col("n_votes") > 0, F.col(f"p{m}")).otherwise(F.lit(mean[m])) for m in range(k)]
    best = F.greatest(*p) if k > 1 else p[0]
    named = F.lit(labels[-1])
    for m in reversed(range(k - 1)):
        named = F.when(p[m] >= best, labels[m]).otherwise(named)
    labelled = q.select(*key, named.alias("label"), best.alias("probability"), *[p[m].alias(f"p_{c}") for m, c in enumerate(labels)], "n_votes")

    # reliability: the chance of the right label over the classes, with the posterior's spread
    wide = counts.groupBy("__a").agg(
        *[F.coalesce(F.sum(F.when(F.col("__l") == c, F.col(f"n{m}"))), F.lit(0.0)).alias(f"x_{m}_{j}") for m in range(k) for j, c in enumerate(labels)]
    )
    beta = [[F.col(f"x_{m}_{j}") + F.lit(prior.of(m, c)) for j, c in enumerate(labels)] for m in range(k)]
    row = [sum(b[1:], b[0]) for b in beta]
    conf = [[b / row[m] for b in beta[m]] for m in range(k)]
    centre = sum((F.lit(mean[m]) * conf[m][m] for m in range(1, k)), F.lit(mean[0]) * conf[0][0])
    var = [F.lit(mean[m] ** 2) * conf[m][m] * (F.lit(1.0) - conf[m][m]) / (row[m] + 1.0) for m in range(k)]
    spread = F.sqrt(sum(var[1:], var[0])) * F.lit(1.96)
    n_votes = sum((F.col(f"x_{m}_{j}") for m in range(k) for j in range(k) if (m, j) != (0, 0)), F.col("x_0_0"))
    people = wide.select(
        F.col("__a").alias("annotator"),
        centre.alias("reliability"),
        F.greatest(centre - spread, F.lit(0.0)).alias("low"),
        F.least(centre + spread, F.lit(1.0)).alias("high"),
        F.round(n_votes).cast("bigint").alias("n_votes"),
        *[conf[m][j].alias(f"c_{labels[m]}_{labels[j]}") for m in range(k) for j in range(k)],
    )
    return Consensus(labelled, people, done, converged)


Fit = tuple[DataFrame, DataFrame, list[float], int, bool]  # items with p<m> and n_votes; counts of the pairs; counts of the classes; rounds; converged


def _fit_shared(given: DataFrame, every: DataFrame | None, key: list[str], prior: _Prior, rounds: int, tolerance: float, known: list[tuple[str, str]]) -> Fit:
    """The fit with the counts on the driver: one row per item with the codes of its votes, at most as many as ``known``."""
    spark, labels, k = given.sparkSession, prior.labels, len(prior.labels)
    codes = spark.createDataFrame([(a, c, i) for i, (a, c) in enumerate(known)], "__a string, __l string, __code int")
    coded = given.select(*key, F.col("__a").cast("string").alias("__a"), "__l").join(F.broadcast(codes), ["__a", "__l"]).select(*key, "__code")  # at most PAIRS rows
    if every is not None:
        coded = coded.withColumn("__own", F.lit(False)).unionByName(every.withColumn("__code", F.lit(None).cast("int")))
    own = [F.max("__own").alias("__own")] if every is not None else []
    grouped = store(coded.groupBy(*key).agg(F.collect_set("__code").alias("__codes"), *own), "items")
    annotators = {a: i for i, a in enumerate(dict.fromkeys(a for a, _ in known))}
    who = np.array([annotators[a] for a, _ in known], np.int64)
    base = np.array([[prior.of(m, c) for m in range(k)] for _, c in known]).reshape(-1, k)

    def weights(n: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected log probabilities of every pair, and of the classes but for a constant."""
        sums = np.zeros((len(annotators), k))
        np.add.at(sums, who, n)
        return _digamma(n + base, np.log) - _digamma(sums + prior.row, np.log)[who], _digamma(total + prior.share, np.log)

    def posterior(codes: pa.Array, w: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat, ends = codes.flatten().to_numpy(), np.cumsum(_lengths(codes))
        logs = np.zeros((len(flat) + 1, k))
        np.cumsum(w[flat], axis=0, out=logs[1:])
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        e = logs[ends] - logs[starts] + shares
        e = np.exp(e - e.max(1, keepdims=True)) if len(e) else e
        return e / e.sum(1, keepdims=True), flat, ends - starts

    def step(w: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shared = spark.sparkContext.broadcast((w, shares))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, s = np.zeros((len(known) + 1, k)), shared.value
            for b in batches:
                p, flat, size = posterior(b.column(0), *s)
                spread = np.repeat(p, size, axis=0)
                for m in range(k):
                    n[:-1, m] += np.bincount(flat, spread[:, m], len(known))
                n[-1] += p.sum(0)
            used = np.flatnonzero(n.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *[pa.array(n[used, m]) for m in range(k)]], ["code", *[f"n{m}" for m in range(k)]])

        part = grouped.select("__codes").mapInArrow(run, "code int, " + ", ".join(f"n{m} double" for m in range(k)))
        n = np.zeros((len(known) + 1, k))
        for r in part.groupBy("code").agg(*[F.sum(f"n{m}").alias(f"n{m}") for m in range(k)]).collect():  # at most PAIRS + 1 rows
            n[r[0]] = r[1:]
        return n[:-1], n[-1]

    # round 0: every vote counts for its own label's class
    size = np.zeros(len(known))
    for code, n in grouped.select(F.explode("__codes").alias("c")).groupBy("c").agg(F.count(F.lit(1))).collect():
        size[code] = n
    n = np.array([[size[i] if labels[m] == c else 0.0 for m in range(k)] for i, (_, c) in enumerate(known)]).reshape(-1, k)
    total = np.full(k, grouped.count() / k)
    done, converged = 0, False
    while known and done < rounds and not converged:
        new, new_total = step(*weights(n, total))
        converged = max(np.abs(new - n).max(), np.abs(new_total - total).max()) <= tolerance * max(1.0, new.max())
        n, total, done = new, new_total, done + 1
    final = spark.sparkContext.broadcast(weights(n, total))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in grouped.select(*key).schema)
    shown = (grouped.where("__own") if every is not None else grouped).select(*key, "__codes")

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, _, size = posterior(b.column(b.num_columns - 1), *final.value)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(p[:, m]) for m in range(k)], pa.array(size, pa.int64())], [*key, *[f"p{m}" for m in range(k)], "n_votes"])

    q = shown.mapInArrow(last, kinds + ", " + ", ".join(f"p{m} double" for m in range(k)) + ", n_votes bigint")
    counts = spark.createDataFrame([(a, c, *map(float, n[i])) for i, (a, c) in enumerate(known)], "__a string, __l string, " + ", ".join(f"n{m} double" for m in range(k)))
    return q, counts, [float(x) for x in total], done, bool(converged) or not known


def _lengths(codes: pa.Array) -> np.ndarray:
    """The lengths of the lists of an array without null lists."""
    return np.diff(codes.offsets.to_numpy())


def _fit_joined(given: DataFrame, every: DataFrame | None, key: list[str], prior: _Prior, rounds: int, tolerance: float, known: list[tuple[str, str]]) -> Fit:
    """The fit with the counts as a table: votes meet them in joins, whose hot annotators the engine splits."""
    labels, k = prior.labels, len(prior.labels)
    v = cut(given.distinct())
    sizes = v.groupBy("__a", "__l").agg(F.count(F.lit(1)).cast("double").alias("n"))
    counts = cut(sizes.select("__a", "__l", *[F.when(F.col("__l") == c, F.col("n")).otherwise(0.0).alias(f"n{m}") for m, c in enumerate(labels)]))
    bare = every.select(*key).distinct().join(v.select(*key).distinct(), key, "left_anti").count() if every is not None else 0
    total = [(v.select(*key).distinct().count() + bare) / k] * k

    def posterior(counts: DataFrame, total: Sequence[float]) -> DataFrame:
        own = Window.partitionBy("__a")
        tops = [F.col(f"n{m}") + F.when(F.col("__l") == c, prior.diagonal).otherwise(prior.other) for m, c in enumerate(labels)]
        sums = [F.sum(f"n{m}").over(own) + F.lit(prior.row) for m in range(k)]
        psi = counts.select("__a", "__l", F.array(*tops, *sums).alias("x")).select("__a", "__l", F.transform("x", digamma).alias("d"))
        logs = v.join(psi.select("__a", "__l", *[(F.col("d")[m] - F.col("d")[k + m]).alias(f"w{m}") for m in range(k)]), ["__a", "__l"]).groupBy(*key).agg(
            *[(F.sum(f"w{m}") + F.lit(float(_digamma(total[m] + prior.share, np.log)))).alias(f"e{m}") for m in range(k)], F.count(F.lit(1)).alias("n_votes")
        )
        top = F.greatest(*[F.col(f"e{m}") for m in range(k)]) if k > 1 else F.col("e0")
        logs = logs.select(*key, "n_votes", *[F.exp(F.col(f"e{m}") - top).alias(f"e{m}") for m in range(k)])
        norm = sum((F.col(f"e{m}") for m in range(1, k)), F.col("e0"))
        return logs.select(*key, "n_votes", *[(F.col(f"e{m}") / norm).alias(f"p{m}") for m in range(k)])

    def sums(q: DataFrame, total: Sequence[float]) -> list[float]:
        """The counts of the classes: of items with votes, and of those without, whose probabilities are the shares'."""
        row = q.agg(*[F.coalesce(F.sum(f"p{m}"), F.lit(0.0)) for m in range(k)]).first()
        e = np.exp([_digamma(t + prior.share, np.log) for t in total])
        return [float(row[m] + bare * e[m] / e.sum()) for m in range(k)]

    done, converged = 0, False
    while done < rounds and not converged:
        q = cut(posterior(counts, total))
        new = cut(v.join(q, key).groupBy("__a", "__l").agg(*[F.sum(f"p{m}").alias(f"n{m}") for m in range(k)]))
        moved = [F.abs(F.col(f"n{m}") - F.col(f"o{m}")) for m in range(k)]
        old = counts.select("__a", "__l", *[F.col(f"n{m}").alias(f"o{m}") for m in range(k)])
        far = new.join(old, ["__a", "__l"]).agg(F.max(F.array_max(F.array(*moved))).alias("d"), F.max(F.array_max(F.array(*[F.col(f"n{m}") for m in range(k)]))).alias("t")).first()
        new_total = sums(q, total)
        converged = max(far.d, *(abs(a - b) for a, b in zip(new_total, total, strict=True))) <= tolerance * max(1.0, far.t)
        counts, total, done = new, new_total, done + 1
    q = posterior(counts, total)
    if every is not None:
        q = every.select(*key).distinct().join(q, key, "left").select(*key, *[f"p{m}" for m in range(k)], F.coalesce("n_votes", F.lit(0)).alias("n_votes"))
    return q, counts, total, done, converged


def krippendorff_alpha(votes: DataFrame, item: Sequence[str], label: str = "label") -> DataFrame:
    """Nominal alpha over all items with two or more votes: alpha, n_items, n_votes.

    Votes with a null item or label are none. Alpha is null if there is no pairable vote, or only one label.
    """
    cells = votes.dropna(subset=[*item, label]).groupBy(*item, F.col(label).alias("__l")).agg(F.count(F.lit(1)).alias("__n"))
    units = cells.groupBy(*item).agg(F.sum("__n").alias("m"), F.sum(F.col("__n") * F.col("__n")).alias("sq"))
    units = units.where("m > 1")
    seen = units.agg(
        F.sum((F.col("m") * F.col("m") - F.col("sq")) / (F.col("m") - 1)).alias("disagree"), F.sum("m").alias("n"), F.count(F.lit(1)).alias("n_items")
    )
    by_label = cells.join(units.select(*item), list(item), "left_semi").groupBy("__l").agg(F.sum("__n").alias("c"))
    expected = by_label.agg(F.sum(F.col("c") * F.col("c")).alias("squares"))
    apart = F.col("n") * F.col("n") - F.col("squares")
    return seen.crossJoin(F.broadcast(expected)).select(  # one row on either side
        (F.lit(1.0) - (F.col("n") - 1) * F.col("disagree") / F.nullif(apart, F.lit(0))).alias("alpha"),
        F.col("n_items"),
        F.coalesce("n", F.lit(0)).alias("n_votes"),
    )
