"""Blind review packets: frozen masters, packets per role, checks of what comes back, merging and adjudication.

Checks return violations as rows instead of stopping at the first; nothing is collected but counts and digests of fixed size.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.evaluation import blind_packet, competition_ranks_valid, roster_difference

# The forms of the columns of annotation and ranking files.
FORMS = {
    "requisition_id": r"^job_[a-f0-9]{12}$",
    "candidate_id": r"^cand_[a-f0-9]{12}$",
    "criterion_id": r"^crit_[a-f0-9]{12}$",
    "criteria_version": r"^v[0-9]{1,3}(\.[0-9]{1,3}){0,2}$",
    "pipeline_version": r"^[a-z0-9][a-z0-9._-]{0,63}$",
    "job_family": r"^[a-z0-9][a-z0-9_-]{0,63}$",
    "cv_language": r"^([a-z]{2,3}(-[a-z0-9]{2,8})*|unknown)$",
    "source_format": r"^(pdf_text|pdf_scan|docx|txt|image|other|unknown)$",
    "model_result": r"^(matched|partial|unknown|needs_verification|parse_error)$",
}


def form_violations(rows: DataFrame, forms: Mapping[str, str] = FORMS) -> DataFrame:
    """``rows`` that break the form of a column they have, with the names of these columns as ``violations``; a null breaks it, outer blanks don't."""
    own = [c for c in forms if c in rows.columns]
    bad = F.array_compact(F.array(*[F.when(~F.coalesce(F.trim(F.col(c)).rlike(forms[c]), F.lit(False)), F.lit(c)) for c in own]))
    return rows.withColumn("violations", bad).where(F.size("violations") > 0)


def master_violations(master: DataFrame, keys: Sequence[str], blank: Sequence[str] = (), group: str | None = None, rank: str | None = None, single: Sequence[str] = ("criteria_version", "pipeline_version"), per_group: Sequence[str] = ("job_family", "criteria_version")) -> DataFrame:
    """What is wrong with a master before packets are made: violation, value, n.

    Keys must be unique, ``blank`` columns empty, ``single`` columns of one value; with ``group`` and ``rank`` every group has two rows and more, ranks 1..n
    once each, and one value of each of ``per_group``.
    """
    text = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit(""))
    one = lambda name, value, n: [F.lit(name).alias("violation"), value.cast("string").alias("value"), n.cast("bigint").alias("n")]
    twice = master.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    out = twice.select(*one("duplicate_key", F.concat_ws("/", *keys), F.col("n")))
    if blank:
        filled = master.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), text(c).alias("t")) for c in blank])).alias("x")).where("x.t <> ''")
        out = out.unionByName(filled.groupBy("x.c").agg(F.count(F.lit(1)).alias("n")).select(*one("already_reviewed", F.col("c"), F.col("n"))))
    for c in single:
        if c in master.columns:
            out = out.unionByName(master.agg(F.countDistinct(text(c)).alias("n")).where("n > 1").select(*one("several_versions", F.lit(c), F.col("n"))))
    if group and rank:
        r = F.trim(rank).try_cast("int")
        per = master.groupBy(F.col(group).alias("g")).agg(
            F.count(F.lit(1)).alias("n"), F.countDistinct(r).alias("d"), F.min(r).alias("lo"), F.max(r).alias("hi"), *[F.countDistinct(text(c)).alias(f"k_{c}") for c in per_group if c in master.columns]
        )
        whole = (F.col("n") > 1) & (F.col("d") == F.col("n")) & (F.col("lo") == 1) & (F.col("hi") == F.col("n"))
        out = out.unionByName(per.where(~F.coalesce(whole, F.lit(False))).select(*one("incomplete_ranks", F.col("g"), F.col("n"))))
        for c in per_group:
            if c in master.columns:
                out = out.unionByName(per.where(F.col(f"k_{c}") > 1).select(*one(f"mixed_{c}", F.col("g"), F.col(f"k_{c}"))))
    return out


def prepare_packet(master: DataFrame, context: Sequence[str], role: str, run_id: str, blank: Sequence[str], seed: int, group: str | None = None) -> DataFrame:
    """A packet for one role: run_id, ``context``, reviewer_role and ``blank`` columns, in an order that tells nothing (within ``group`` if given)."""
    if role not in ("recruiter", "hiring_manager"):
        raise ValueError("the role is recruiter or hiring_manager")
    rows = blind_packet(master, context, seed, group)
    return rows.select(F.lit(run_id).alias("run_id"), *context, F.lit(role).alias("reviewer_role"), *[F.lit("").alias(c) for c in blank])


def packet_violations(packet: DataFrame, master: DataFrame, keys: Sequence[str], context: Sequence[str], role: str, run_id: str, group: str | None = None, rank: str | None = None) -> DataFrame:
    """What is wrong with a packet that came back: keys, violation. Wrong run, role or context, doubled, missing and unknown rows, and ranks that aren't 1, 1, 3."""
    k = list(keys)
    text = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit(""))
    p = packet.select(*k, F.struct(*[text(c) for c in context]).alias("pc"), text("run_id").alias("run"), text("reviewer_role").alias("role"))
    m = master.select(*k, F.struct(*[text(c) for c in context]).alias("mc")).dropDuplicates(k)
    pairs = p.join(m, k, "left")
    codes = F.array_compact(F.array(
        F.when(F.col("run") != run_id, "other_run"), F.when(F.col("role") != role, "other_role"), F.when(F.col("mc").isNotNull() & (F.to_json("pc") != F.to_json("mc")), "changed_context"),
    ))
    out = pairs.select(*k, F.explode(codes).alias("violation"))
    twice = p.groupBy(*k).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*k, F.lit("doubled").alias("violation"))
    sides = roster_difference(master, packet, k).select(*k, F.when(F.col("side") == "master", "missing").otherwise("unknown").alias("violation"))
    out = out.unionByName(twice).unionByName(sides)
    if group and rank:
        ranks = packet.select(group, F.trim(rank).try_cast("bigint").alias("r"))
        bad = competition_ranks_valid(ranks, group, "r").where("not valid").select(group)
        out = out.unionByName(packet.join(bad, group, "left_semi").select(*k, F.lit("bad_ranks").alias("violation")))
    return out.distinct()


def newest_labels(packets: DataFrame, keys: Sequence[str], values: Sequence[str], at: str = "labelled_at", by: str = "annotator") -> DataFrame:
    """One row per key with the ``values`` of the newest label, where several people labelled for one role; ties go to the larger name."""
    return packets.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(at, by, *values)).alias("x")).select(*keys, "x.*")


def merge_packets(master: DataFrame, recruiter: DataFrame, manager: DataFrame, keys: Sequence[str], values: Sequence[str] = ("reviewer_label", "reference_label")) -> DataFrame:
    """The master with both roles' ``values`` as <role>_label and so on: rows that all three have. Packets have one row per key (``newest_labels``)."""
    k = list(keys)
    named = lambda df, role: df.select(*k, *[F.col(v).alias(f"{role}_{v.removeprefix('reviewer_')}") for v in values])
    return master.join(named(recruiter, "recruiter"), k).join(named(manager, "hiring_manager"), k)


def ranks_digest(rows: DataFrame, columns: Sequence[str]) -> str:
    """A SHA-256 of a set of rows that does not depend on their order: of the number of rows and the sums of pieces of each row's own hash."""
    text = F.to_json(F.array(*[F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) for c in columns]))
    pieces = [F.conv(F.substring(F.sha2(text, 256), 1 + 13 * i, 13), 16, 10).cast("decimal(38,0)") for i in range(4)]
    total = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(p).alias(f"s{i}") for i, p in enumerate(pieces)])
    return total.select(F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in total.columns]), 256).alias("d")).first().d


def apply_adjudication(master: DataFrame, sheet: DataFrame, keys: Sequence[str], ranks: Sequence[str], locked: Sequence[str], digest: str) -> DataFrame:
    """The master with the ``ranks`` of a finished sheet; raises if the ``locked`` ones are not those of ``digest`` (made by ``ranks_digest`` over keys and locked)."""
    if ranks_digest(sheet, [*keys, *locked]) != digest:
        raise ValueError("reviewers' ranks changed after they were locked")
    return master.drop(*ranks).join(sheet.select(*keys, *ranks), list(keys))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """Path, length and SHA-256 of the bytes of every file under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def freeze(spark: SparkSession, path: str) -> dict[str, str]:
    """The lock of a master file: its hash and a new run id. Raises if there isn't exactly one file."""
    rows = file_digests(spark, path).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a master is one file")
    return {"master_sha256": rows[0].sha256, "run_id": uuid.uuid4().hex}


def fingerprint(spark: SparkSession, root: str) -> str:
    """A SHA-256 of a folder: of relative path, length and hash of its files, whatever their order on disk. Raises if there are none."""
    base = os.path.abspath(root.removeprefix("file:")).rstrip("/") + "/"
    rows = file_digests(spark, root).withColumn("path", F.substring_index("path", base, -1))
    if not rows.limit(1).count():
        raise ValueError("the folder holds no files")
    return ranks_digest(rows, ["path", "length", "sha256"])


def outside(path: str, root: str) -> str:
    """The real path of ``path``; raises if it lies within ``root``."""
    real, base = os.path.realpath(path), os.path.realpath(root)
    if os.path.commonpath([real, base]) == base:
        raise ValueError(f"{path} lies within {root}")
    return real


def shuffled(df: DataFrame, seed: int, keys: Sequence[str]) -> DataFrame:
    """Rows in an order by a keyed hash, the same for the same seed."""
    order: Column = F.sha2(F.concat_ws("\u001f", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys]), 256)
    return df.orderBy(order)
