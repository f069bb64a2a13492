"""Evaluation of labels and rankings, with privacy suppression of small groups."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.operators.analytics import cohen_kappa
from corvane.operators.positions import positions, quantiles

CITING = ("matched", "partial", "needs_verification")  # fixed values: results that should name their evidence
LEAST_CANDIDATES = 5  # distinct candidates below which a value is withheld


def confusion(rows: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """Counts of (actual, predicted) per ``keys``; rows with a null are left out."""
    return rows.dropna(subset=[actual, predicted]).groupBy(*keys, F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def label_metrics(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per label of a confusion table: support, precision, recall, F1; null where a denominator is 0."""
    k = list(keys)
    sides = cells.select(*k, F.explode(F.array(F.struct(F.lit("a").alias("s"), F.col("actual").alias("label")), F.struct(F.lit("p").alias("s"), F.col("predicted").alias("label")))).alias("x"), "n", (F.col("actual") == F.col("predicted")).alias("hit"))
    per = sides.groupBy(*k, F.col("x.label").alias("label")).agg(
        F.sum(F.when(F.col("x.s") == "a", F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(F.col("x.s") == "p", F.col("n")).otherwise(0)).alias("predicted"),
        F.sum(F.when((F.col("x.s") == "a") & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
    )
    return per.select(*k, "label", "support", F.try_divide("tp", "predicted").alias("precision"), F.try_divide("tp", "support").alias("recall"), F.try_divide(F.col("tp") * 2, F.col("predicted") + F.col("support")).alias("f1"))


def overlap(rows: DataFrame, predicted: str, expected: str) -> DataFrame:
    """Micro precision, recall and F1 of two array columns, by their distinct values."""
    p, e = F.array_distinct(F.coalesce(predicted, F.array())), F.array_distinct(F.coalesce(expected, F.array()))
    s = rows.agg(F.sum(F.size(F.array_intersect(p, e))).alias("tp"), F.sum(F.size(p)).alias("np"), F.sum(F.size(e)).alias("ne"))
    return s.select(F.try_divide("tp", "np").alias("precision"), F.try_divide("tp", "ne").alias("recall"), F.try_divide(F.col("tp") * 2, F.col("np") + F.col("ne")).alias("f1"), "tp", "np", "ne")


def suppressed(value: Column, candidates: Column, least: int = LEAST_CANDIDATES) -> Column:
    """``value`` where it stands for at least ``least`` candidates, else null."""
    return F.when(candidates >= least, value)


def stratified(rows: DataFrame, strata: Sequence[str], candidate: str, measures: dict[str, Column], least: int = LEAST_CANDIDATES, hide: str = "smallest") -> DataFrame:
    """``measures`` per value of each stratum (field, value), withheld for small groups.

    If exactly one value of a field is withheld, one more is (the ``smallest`` or ``largest`` that is
    visible, ties by the larger value), so that the withheld one can't be had by difference. The strata are read in one Expand.
    """
    one = F.explode(F.array(*[F.struct(F.lit(s).alias("field"), F.col(s).cast("string").alias("value")) for s in strata]))
    long = rows.select("*", one.alias("__x")).select("*", "__x.field", "__x.value")
    per = long.groupBy("field", "value").agg(F.countDistinct(candidate).alias("candidates"), *[m.alias(n) for n, m in measures.items()])
    field = Window.partitionBy("field")
    visible = F.col("candidates") >= least
    first = F.col("candidates").asc() if hide == "smallest" else F.col("candidates").desc()
    place = F.row_number().over(Window.partitionBy("field", visible).orderBy(first, F.col("value").desc_nulls_last()))
    a = per.withColumn("__hidden", F.count_if(~visible).over(field)).withColumn("__place", place)
    shown = visible & ~((F.col("__hidden") == 1) & (F.col("__place") == 1))
    return a.select("field", "value", shown.alias("reported"), *[F.when(shown, F.col(c)).alias(c) for c in ("candidates", *measures)])


def locator_report(rows: DataFrame) -> DataFrame:
    """Rows of annotations that should name their evidence: expected, present, missing and the rate."""
    expects = F.col("model_result").isin(*CITING)
    has = (F.trim(F.coalesce("model_evidence_ref", F.lit(""))) != "") | (F.trim(F.coalesce("model_evidence_page", F.lit(""))) != "")
    c = rows.agg(F.count_if(expects).alias("expected"), F.count_if(expects & has).alias("present"))
    return c.select("expected", "present", (F.col("expected") - F.col("present")).alias("missing"), F.try_divide("present", "expected").alias("rate"))


def citation_report(rows: DataFrame, label: str = "adjudicated_reference_label") -> DataFrame:
    """Validity valid/(valid+incorrect) and coverage valid/(valid+incorrect+missing) of rows that should cite."""
    x = F.lower(F.trim(label))
    c = rows.where(F.col("model_result").isin(*CITING)).agg(*[F.count_if(x == v).alias(v) for v in ("valid", "incorrect", "missing")])
    both = F.col("valid") + F.col("incorrect")
    return c.select("valid", "incorrect", "missing", F.try_divide("valid", both).alias("validity"), F.try_divide("valid", both + F.col("missing")).alias("coverage"))


def locator_violations(rows: DataFrame) -> DataFrame:
    """Annotation rows whose reference label contradicts the presence of a locator or the model's result, with a code."""
    ref = F.trim(F.coalesce("model_evidence_ref", F.lit("")))
    label = F.lower(F.trim(F.coalesce("adjudicated_reference_label", F.lit(""))))
    positive = F.col("model_result").isin("matched", "partial")
    code = F.when(label.isin("valid", "incorrect") & (ref == ""), "cited_without_reference").when((label == "missing") & (ref != ""), "missing_with_reference").when((label == "not_applicable") & positive, "positive_not_applicable")
    return rows.withColumn("violation", code).where("violation is not null")


def _agreeing(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> int:
    """Concordant minus discordant pairs of weighted points with different (x, y); ties in either count in neither.

    A merge sort whose levels are array operations: sorted by x and y, every right half is looked up in its left one.
    """
    if len(x) <= 48:
        dx, dy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
        return int((dx * dy * n[:, None].astype(np.int64) * n).sum()) // 2
    order = np.lexsort((y, x))
    x, n = x[order], n[order].astype(np.int64)
    rank = np.unique(y[order], return_inverse=True)[1].astype(np.int64)
    top, m, total, width = int(rank.max()) + 1 if len(rank) else 1, len(x), 0, 1
    at = np.arange(m)
    while width < m:
        block, left = at // (2 * width), (at // width) % 2 == 0
        key = block * top + rank
        lk = np.sort(key[left])
        cum = np.concatenate([[0], np.cumsum(n[left][np.argsort(key[left], kind="stable")])])
        r, b = key[~left], block[~left] * top
        lo, hi = cum[np.searchsorted(lk, r, "left")], cum[np.searchsorted(lk, r, "right")]
        first, end = cum[np.searchsorted(lk, b, "left")], cum[np.searchsorted(lk, b + top, "left")]
        total += int((n[~left] * ((lo - first) - (end - hi))).sum())
        width *= 2
    # pairs of equal x came out as concordant, as they are sorted by y
    per = np.bincount(np.unique(x, return_inverse=True)[1], n).astype(np.int64) if m else np.zeros(0, np.int64)
    return total - (int((per * per).sum()) - int((n * n).sum())) // 2


def kendall_tau_b(ranks: DataFrame, group: str, item: str, left: str, right: str, bucket: int = 4096) -> DataFrame:
    """Kendall's tau-b per group: items, tau; null where undefined. Rows with a null are left out.

    Ranks are positive integers. They are cut into buckets of ``bucket`` ranks on either side; pairs that share no bucket are counted
    among the buckets, those that share one or both within these. So no task holds a whole group, however large.
    """
    cells = ranks.dropna(subset=[group, left, right]).groupBy(F.col(group).alias("g"), F.col(left).cast("bigint").alias("l"), F.col(right).cast("bigint").alias("r")).agg(F.count(F.lit(1)).alias("n"))
    lb, rb = F.floor(F.col("l") / bucket), F.floor(F.col("r") / bucket)
    none = F.lit(-1).cast("bigint")
    view = lambda on, a, b, x, y: F.when(on, F.struct(a.alias("a"), b.alias("b"), x.alias("x"), y.alias("y")))
    wide = cells.groupBy("g").agg(F.max(lb).alias("ml"), F.max(rb).alias("mr"))
    several_l, several_r = F.col("ml") > 0, F.col("mr") > 0  # in one bucket all pairs share it
    views = F.array(view(several_l & several_r, none, none, lb, rb), view(several_r, lb, none, F.col("l"), rb), view(several_l, none, rb, lb, F.col("r")), view(F.lit(True), lb, rb, F.col("l"), F.col("r")))
    points = cells.join(wide, "g").select("g", F.posexplode(views).alias("v", "p"), "n").where("p is not null").groupBy("g", "v", "p.a", "p.b", "p.x", "p.y").agg(F.sum("n").alias("n"))
    kind = cells.schema["g"].dataType.simpleString()
    by = ["g", "v", "a", "b"]
    ordered = points.repartition(*by).sortWithinPartitions(*by).select("g", F.xxhash64(*by).alias("h"), "x", "y", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the group in hand, which is no larger than its buckets allow

        def close(t: pa.Table) -> Iterator[pa.RecordBatch]:
            x, y, n, h = (t[c].to_numpy() for c in ("x", "y", "n", "h"))
            cuts = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]])
            d = [_agreeing(x[i:j], y[i:j], n[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([t["g"].combine_chunks().take(pa.array(cuts[:-1])), pa.array(d, pa.int64())], ["g", "d"])

        for b in batches:
            h = b.column(1).to_numpy()
            changes = np.flatnonzero(h[1:] != h[:-1]) + 1
            if held and len(h) and held[-1].column(1)[-1].as_py() != h[0]:
                yield from close(pa.Table.from_batches(held))
                held = []
            last = int(changes[-1]) if len(changes) else 0
            if last:
                yield from close(pa.Table.from_batches([*held, b.slice(0, last)]))
                held = []
            if b.num_rows > last:
                held.append(b.slice(last))
        if held:
            yield from close(pa.Table.from_batches(held))

    diff = ordered.mapInArrow(run, f"g {kind}, d bigint").groupBy("g").agg(F.sum("d").alias("d"))
    n2 = lambda x: x * (x - 1) / 2
    tied = lambda c, name: cells.groupBy("g", c).agg(F.sum("n").alias("x")).groupBy("g").agg(F.sum(n2(F.col("x"))).alias(name))
    every = cells.groupBy("g").agg(F.sum("n").alias("n"))
    root = F.sqrt((n2(F.col("n")) - F.col("tl")) * (n2(F.col("n")) - F.col("tr")))
    return every.join(diff, "g").join(tied("l", "tl"), "g").join(tied("r", "tr"), "g").select(F.col("g").alias(group), "n", F.when(root > 0, F.col("d") / root).alias("tau"))


def top_k_overlap(ranks: DataFrame, group: str, item: str, model: str, judged: str, k: int = 5) -> DataFrame:
    """Per group: precision and recall of the model's strict first k against the judged first k with ties; null for groups under k.

    Only the first k of each side leave their tasks (the engine keeps k per group before the shuffle).
    """
    r = ranks.select(group, item, model, judged)
    sizes = r.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    m = r.withColumn("__p", F.row_number().over(Window.partitionBy(group).orderBy(model, item))).where(F.col("__p") <= k).select(group, item, F.lit(1).alias("m"), F.lit(0).alias("j"))
    j = r.withColumn("__p", F.rank().over(Window.partitionBy(group).orderBy(judged))).where(F.col("__p") <= k).select(group, item, F.lit(0).alias("m"), F.lit(1).alias("j"))
    both = m.unionByName(j).groupBy(group, item).agg(F.max("m").alias("m"), F.max("j").alias("j"))
    c = both.groupBy(group).agg(F.sum(F.col("m") * F.col("j")).alias("both"), F.sum("m").alias("m"), F.sum("j").alias("j"))
    out = sizes.join(c, group, "left")
    return out.select(group, "n", F.when(F.col("n") >= k, F.col("both") / F.col("m")).alias("precision"), F.when(F.col("n") >= k, F.col("both") / F.col("j")).alias("recall"))


def competition_ranks_valid(ranks: DataFrame, group: str, rank: str) -> DataFrame:
    """Whether the ranks of each group are of the form 1, 1, 3, …: the first place of each value is the value itself."""
    first = positions(ranks.select(group, rank), group, [F.col(rank)], "__p").groupBy(group, rank).agg(F.min("__p").alias("p"))
    bad = F.count_if(F.col(rank).isNull() | (F.col("p") != F.col(rank)))
    return first.groupBy(group).agg((bad == 0).alias("valid"))


def ranking_report(ranks: DataFrame, group: str, item: str, model: str, judged: str, strata: Sequence[str] = (), k: int = 5, least: int = LEAST_CANDIDATES) -> DataFrame:
    """Macro averages over requisitions with two items and more: field, value, groups, items, tau, precision, recall.

    One row for all (field null) and one per value of each of ``strata`` (columns that are constant in a group). Values that stand for fewer than
    ``least`` items are withheld; if that hides exactly one value of a field, the largest other (ties: the larger value) is, too.
    """
    per = kendall_tau_b(ranks, group, item, model, judged).where("n > 1").join(top_k_overlap(ranks, group, item, model, judged, k).drop("n"), group)
    own = ranks.groupBy(group).agg(*[F.max(s).alias(s) for s in strata]) if strata else ranks.select(group).distinct()
    one = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value")), *[F.struct(F.lit(s).alias("field"), F.col(s).cast("string").alias("value")) for s in strata])
    long = per.join(own, group).select("*", F.explode(one).alias("x")).select("n", "tau", "precision", "recall", "x.*")
    cells = long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("items"), *[F.avg(c).alias(c) for c in ("tau", "precision", "recall")])
    seen = F.col("items") >= least
    w = Window.partitionBy("field")
    hidden = F.count_if(~seen).over(w)
    place = F.row_number().over(Window.partitionBy("field", seen).orderBy(F.desc("items"), F.col("value").desc_nulls_last()))
    shown = seen & (F.col("field").isNull() | ~((hidden == 1) & (place == 1)))
    return cells.withColumn("reported", shown).select("field", "value", "reported", *[F.when(F.col("reported"), F.col(c)).alias(c) for c in ("groups", "items", "tau", "precision", "recall")])


def agreement_metrics(rows: DataFrame, left: str, right: str, candidate: str, least: int = LEAST_CANDIDATES) -> DataFrame:
    """Compared rows, exact agreement and kappa (null where undefined); withheld if agreeing or disagreeing rows stand for fewer than ``least`` candidates, but some."""
    r = rows.dropna(subset=[left, right])
    same = F.col(left) == F.col(right)
    c = r.agg(F.count(F.lit(1)).alias("rows"), F.count_if(same).alias("exact"), F.countDistinct(F.when(same, F.col(candidate))).alias("a"), F.countDistinct(F.when(~same, F.col(candidate))).alias("b"))
    few = lambda x: (F.col(x) > 0) & (F.col(x) < least)
    shown = ~(few("a") | few("b")) & (F.col("rows") > 0)
    kappa = cohen_kappa(r, left, right, degenerate="null").select("kappa")
    return c.crossJoin(F.broadcast(kappa)).select("rows", shown.alias("reported"), F.when(shown, F.col("exact")).alias("exact"), F.when(shown, F.col("exact") / F.col("rows")).alias("rate"), F.when(shown, F.col("kappa")).alias("kappa"))  # one row on either side


def model_report(rows: DataFrame, actual: str, predicted: str, candidate: str, labels: Sequence[str], least: int = LEAST_CANDIDATES) -> DataFrame:
    """Per label: support, precision, recall, F1, and the accuracy over all; labels of fewer than ``least`` candidates are withheld, and the largest other if one is."""
    r = rows.dropna(subset=[actual, predicted])
    people = r.groupBy(F.col(actual).alias("label")).agg(F.countDistinct(candidate).alias("candidates"))
    every = r.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    m = every.join(label_metrics(confusion(r, actual, predicted)), "label", "left").join(people, "label", "left").na.fill(0, ["support", "candidates"])
    seen = (F.col("candidates") >= least) | (F.col("candidates") == 0)
    w = Window.partitionBy()  # one row per label
    place = F.row_number().over(Window.partitionBy(seen & (F.col("candidates") > 0)).orderBy(F.desc("candidates"), F.desc("label")))
    shown = seen & ~((F.count_if(~seen).over(w) == 1) & (place == 1) & (F.col("candidates") > 0))
    miss = F.col(actual) != F.col(predicted)
    few = lambda x: (F.col(x) > 0) & (F.col(x) < least)
    acc = r.agg(F.count(F.lit(1)).alias("n"), F.count_if(~miss).alias("t"), F.countDistinct(F.when(miss, F.col(candidate))).alias("b"), F.countDistinct(F.when(~miss, F.col(candidate))).alias("a"))
    acc = acc.select(F.when((F.col("n") > 0) & ~few("a") & ~few("b"), F.col("t") / F.col("n")).alias("accuracy"))
    out = m.withColumn("reported", shown).crossJoin(F.broadcast(acc))  # one row
    return out.select("label", "reported", *[F.when(F.col("reported"), F.col(c)).alias(c) for c in ("support", "precision", "recall", "f1")], "accuracy")


def macro(per_group: DataFrame, measures: Sequence[str], n: str = "n", least: int = 2) -> DataFrame:
    """Means over groups with at least ``least`` rows, each group with equal weight."""
    return per_group.where(F.col(n) >= least).agg(F.count(F.lit(1)).alias("groups"), *[F.avg(m).alias(m) for m in measures])


def roster_difference(master: DataFrame, packet: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that only one of two tables has: keys and side (master or packet). Empty if the rosters agree."""
    k = list(keys)
    a, b = master.select(*k).distinct().withColumn("__a", F.lit(1)), packet.select(*k).distinct().withColumn("__b", F.lit(1))
    return a.join(b, k, "full_outer").where("__a is null or __b is null").select(*k, F.when(F.col("__b").isNull(), "master").otherwise("packet").alias("side"))


def blind_packet(master: DataFrame, keep: Sequence[str], seed: int, group: str | None = None) -> DataFrame:
    """``keep`` columns in an order that tells nothing: by a keyed hash, within ``group`` if given."""
    order_ = F.sha2(F.concat_ws("\u001f", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keep]), 256)
    return master.select(*keep).orderBy(*([F.col(group)] if group else []), order_)


def blind_labels(df: DataFrame, group: str, order_by: Sequence[Column]) -> DataFrame:
    """A letter per row of a group, A to Z and round again, in the given order."""
    placed = positions(df, group, order_by, "__p")
    return placed.withColumn("blind_label", F.char(F.lit(65) + (F.col("__p") - 1) % 26)).drop("__p")


def token_error(reference: Column, hypothesis: Column) -> Column:
    """Words of a Levenshtein distance between two token arrays: (edits, reference words), of any length."""
    return _edits(reference, hypothesis)


@F.pandas_udf(T.StructType([T.StructField("edits", T.IntegerType()), T.StructField("words", T.IntegerType())]))
def _edits(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    out = [(None, None) if a is None or b is None else (_distance(list(a), list(b)), len(a)) for a, b in zip(reference, hypothesis, strict=True)]
    return pd.DataFrame(out, columns=["edits", "words"]).astype("Int32")


def _distance(a: list[str], b: list[str]) -> int:
    """Levenshtein distance of two lists: the rows of its table by array operations, insertions by a running minimum."""
    codes: dict[str, int] = {}
    x, y = (np.array([codes.setdefault(w, len(codes)) for w in ws], np.int64) for ws in (a, b))
    row = np.arange(len(y) + 1)
    at = np.arange(len(y) + 1)
    for i, w in enumerate(x.tolist(), 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (y != w))
        row = np.minimum.accumulate(np.concatenate([[i], new]) - at) + at
    return int(row[-1])


_WER_WORD = re.compile(r"[^\W_]+(?:[+#.][^\W_]+|[+#]+)*")


@F.pandas_udf(T.ArrayType(T.StringType()))
def error_tokens(text: pd.Series) -> pd.Series:
    """Words for error rates: compatibility forms and case folded, signs of technical names kept; null has none."""
    return text.map(lambda t: [] if t is None else _WER_WORD.findall(unicodedata.normalize("NFKC", t).casefold()))


def corpus_error(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows (edits, words; null edits: not recognised) summed up per ``keys``: samples, complete, words, edits and micro error rate, null unless all are there."""
    done = F.count("edits") == F.count(F.lit(1))
    total = lambda c: F.when(done, F.sum(c))
    agg = [F.count(F.lit(1)).alias("samples"), F.count("edits").alias("recognised"), F.when(done, "complete").otherwise("partial").alias("state"), total("words").alias("words"), total("edits").alias("edits"), F.try_divide(total("edits"), total("words")).alias("error_rate")]
    return rows.groupBy(*keys).agg(*agg) if keys else rows.agg(*agg)


def groundedness(evidence: DataFrame, lines: DataFrame, ident: str = "candidate_id") -> DataFrame:
    """Positive evidence with its line: ``ident``, criterion_id, verbatim (the snippet stands in a line of the text), attributed.

    Attributed is a snippet that stands on the line it names (line_no); without one, if a line holds one of its first three words.
    """
    e = evidence.where(F.col("result").isin("matched", "partial")).select(ident, "criterion_id", "snippet", "line_no")
    pairs = e.join(lines.select(F.col(ident).alias("__i"), F.col("line_no").alias("__n"), "line"), F.col(ident) == F.col("__i"), "left")
    low, line = F.lower(F.trim(F.coalesce("snippet", F.lit("")))), F.lower(F.trim(F.regexp_replace("line", r"(?U)\s+", " ")))
    inside = (low != "") & F.contains(line, low)
    some = F.exists(F.slice(F.split(low, " "), 1, 3), lambda w: (w != "") & F.contains(line, w))
    yes = lambda c: F.coalesce(F.max(c.cast("int")), F.lit(0)) == 1
    on_line = F.when(F.col("line_no").isNotNull(), inside & (F.col("line_no") == F.col("__n"))).otherwise(some)
    return pairs.groupBy(ident, "criterion_id").agg(yes(inside).alias("verbatim"), yes(on_line).alias("attributed"))


def relevance_labels(df: DataFrame, category: str, primary: Sequence[str], secondary: Sequence[str]) -> DataFrame:
    """``df`` with rel: 2 for a category of ``primary``, 1 for one of ``secondary``, else 0."""
    c = F.coalesce(F.col(category), F.lit(""))
    return df.withColumn("rel", F.when(c.isin(*primary), 2).when(c.isin(*secondary), 1).otherwise(0))


def latency_summary(times: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, median, 95th percentile and maximum of columns of times: measure, n, mean, median, p95, max."""
    long = times.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*").where("v is not null")
    q = quantiles(long, "measure", "v", {"median": 0.5, "p95": 0.95})
    return long.groupBy("measure").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.max("v").alias("max")).join(q, "measure").select("measure", "n", "mean", "median", "p95", "max")


def inject_headers(docs: DataFrame, headers: DataFrame, text: str = "text") -> DataFrame:
    """Every document once per header (variant, header) with it as first line, for invariance tests; ``headers`` is a short list."""
    return docs.crossJoin(F.broadcast(headers)).withColumn(text, F.concat_ws("\n", "header", text)).drop("header")  # a stated list of variants


def counterfactual(evidence: DataFrame, injected: DataFrame, score: Column, ident: str = "candidate_id") -> DataFrame:
    """Largest and mean change of a score under injected variants: both tables hold ``ident`` and result, weight (and variant)."""
    base = evidence.groupBy(ident).agg(score.alias("base"))
    alt = injected.groupBy(ident, "variant").agg(score.alias("alt"))
    d = alt.join(base, ident).select(ident, F.abs(F.col("alt") - F.col("base")).alias("d"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), F.max("d").alias("max"), F.count_if(F.col("d") == 0).alias("unchanged"))
