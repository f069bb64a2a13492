"""References to records that do not exist, from signed counts per key.

Change deltas of both sides are folded into a state: how many rows bring a key into existence at a time, and how many
rows refer to it at a time. A row that goes takes back its own count, so what remains is the existence and
the earliest times of the rows that are left. Keys with positive references and zero existence (or an existence that begins
after a reference) are suspect; only rows whose key is suspect are looked at one by one.

Counts are summed map-side before the shuffle, so a key that a third of the rows
name at few times costs few partial rows per task, and the engine splits it in the join with its rows. The state can be kept and folded with later deltas.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.instants import instant, key_text


@dataclass(frozen=True)
class Reference:
    """Column ``field`` of ``rows`` (known as ``src_table``) names keys of table ``target``."""

    src_table: str
    rows: DataFrame
    field: str
    target: str
    row_id: str = "id"
    at: str = "created_at"


def reference_rows(refs: Sequence[Reference]) -> DataFrame:
    """One row per reference: src_table, row_id, ref_field, target, key, at. Null and blank keys are none."""
    parts = [
        r.rows.select(
            F.lit(r.src_table).alias("src_table"),
            F.col(r.row_id).cast("string").alias("row_id"),
            F.lit(r.field).alias("ref_field"),
            F.lit(r.target).alias("target"),
            key_text(F.col(r.field)).alias("key"),
            instant(F.col(r.at)).alias("at"),
        ).where(F.col("key").isNotNull())
        for r in refs
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def existence_deltas(target: str, rows: DataFrame, key: str = "id", at: str = "created_at", sign: int = 1) -> DataFrame:
    """Deltas of rows that came (``sign`` 1) or went (-1): target, key, exist_delta, ref_delta, born, named.

    A row that goes must name the time it came with. Copies of a row count each, so drop them first where some may go.
    """
    return rows.select(
        F.lit(target).alias("target"),
        key_text(F.col(key)).alias("key"),
        F.lit(sign).cast("bigint").alias("exist_delta"),
        F.lit(0).cast("bigint").alias("ref_delta"),
        # a row without a readable time exists since ever
        F.coalesce(instant(F.col(at)), F.lit("0001-01-01 00:00:00").cast("timestamp")).alias("born"),
        F.lit(None).cast("timestamp").alias("named"),
    ).where(F.col("key").isNotNull())


def reference_deltas(references: DataFrame, sign: int = 1) -> DataFrame:
    """Deltas of the rows of ``reference_rows``."""
    return references.select(
        "target",
        "key",
        F.lit(0).cast("bigint").alias("exist_delta"),
        F.lit(sign).cast("bigint").alias("ref_delta"),
        F.lit(None).cast("timestamp").alias("born"),
        F.col("at").alias("named"),
    )


def _together(deltas: Sequence[DataFrame]) -> DataFrame:
    every = deltas[0]
    for d in deltas[1:]:
        every = every.unionByName(d)
    return every


def fold(*deltas: DataFrame) -> DataFrame:
    """State per (target, key, born, named): sums of the deltas.

    A state has the columns of a delta, so ``fold(state, new_deltas)`` keeps it current. A time of existence whose count fell to 0
    stays as the trace of a deletion; references that are gone leave none.
    """
    state = _together(deltas).groupBy("target", "key", "born", "named").agg(F.sum("exist_delta").alias("exist_delta"), F.sum("ref_delta").alias("ref_delta"))
    return state.where(F.col("born").isNotNull() | (F.col("ref_delta") != 0)).select("target", "key", "exist_delta", "ref_delta", "born", "named")


def suspects(state: DataFrame) -> DataFrame:
    """Keys that are referred to and do not exist, or not yet when first named: target, key, born (null: none is left), gone (it existed once).

    ``state`` is a folded one, or deltas of rows that came only.
    """
    per = state.groupBy("target", "key").agg(
        F.sum("exist_delta").alias("n"), F.sum("ref_delta").alias("refs"), F.max(F.col("born").isNotNull()).alias("once"),
        F.min(F.when(F.col("exist_delta") > 0, F.col("born"))).alias("born"), F.min(F.when(F.col("ref_delta") > 0, F.col("named"))).alias("named"),
    )
    absent = F.col("n") <= 0
    bad = per.where((F.col("refs") > 0) & (absent | (F.col("born") > F.col("named"))))
    return bad.select("target", "key", F.when(~absent, F.col("born")).alias("born"), (absent & F.col("once")).alias("gone"))


def broken_references(refs: Sequence[Reference], targets: dict[str, DataFrame]) -> DataFrame:
    """Broken references, one distinct row each: src_table, row_id, ref_field, target, key, at, reason.

    ``reason`` is ``absent`` or ``later`` (the key's first row is younger than the reference; an
    equal instant is not), or ``deleted`` by a state that saw the key's rows go. Keys are compared without case and outer white space. Null and blank
    references are none; a reference without a readable time is broken only if the key is absent.
    Copies of a row count once; empty tables give no rows, or, as targets, make every key absent.
    """
    rows = reference_rows(refs)
    return broken_rows(rows, suspects(_together([reference_deltas(rows), *[existence_deltas(t, df) for t, df in targets.items()]])))


def broken_rows(rows: DataFrame, bad: DataFrame) -> DataFrame:
    """The rows of ``reference_rows`` that are broken by the ``suspects`` of a state."""
    hit = rows.join(bad, ["target", "key"], "inner").where(F.col("born").isNull() | (F.col("born") > F.col("at")))
    reason = F.when(F.col("born").isNotNull(), "later").when(F.col("gone"), "deleted").otherwise("absent")
    return hit.select("src_table", "row_id", "ref_field", "target", "key", "at", reason.alias("reason")).distinct()


def orphan_report(broken: DataFrame, period: str = "month") -> DataFrame:
    """Broken references per table, field, reason and period (``date_trunc`` unit) of the referring row."""
    return broken.groupBy(
        "src_table", "ref_field", "reason", F.date_trunc(period, "at").cast("date").alias("period")
    ).agg(F.count(F.lit(1)).alias("n_references"), F.countDistinct("key").alias("n_keys"))
