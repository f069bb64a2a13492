"""Sinks: CSV and JSON exports, audit rows, packets that never overwrite, table snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def export_csv(df: DataFrame, path: str, order: Sequence[Column] = (), single: bool = True, mark: bool = False) -> None:
    """A CSV folder with header; ``single`` writes one file and is for reports, not for tables; ``mark`` puts a byte order mark before the header."""
    out = df.orderBy(*order) if order else df
    if mark:
        out = out.withColumnRenamed(out.columns[0], "\ufeff" + out.columns[0])
    (out.coalesce(1) if single else out).write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def joined_notes(reviews: DataFrame, separator: str = " | ") -> DataFrame:
    """The non-blank notes of each candidate, newest first, as one text."""
    n = reviews.where("trim(note) <> ''").select("candidate_id", F.struct("created_at", "id", "note").alias("x")).distinct()
    return n.groupBy("candidate_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x"), asc=False), lambda x: x["note"]), separator).alias("notes"))


def audit_rows(df: DataFrame, event_type: str, actor: Column, details: Column) -> DataFrame:
    """Audit rows of an event, one per row of ``df``; ids follow from the content, so a retry appends the same ids."""
    text = F.to_json(details)
    ident = F.concat(F.lit("audit_"), F.substring(F.sha2(F.concat_ws(":", F.lit(event_type), "job_id", "candidate_id", actor, text), 256), 1, 12))
    return df.select(ident.alias("id"), "job_id", "candidate_id", actor.alias("actor"), F.lit(event_type).alias("event_type"), text.alias("details_json"))


def delete_cascade(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The tables without the rows of the candidates ``ids`` (column candidate_id).

    A table audit_events keeps the events of others and gains one ``candidate_deleted`` per candidate that was there.
    """
    gone = ids.select("candidate_id").distinct()
    out = {n: df.join(gone.withColumnRenamed("candidate_id", "id") if n == "candidates" else gone, "id" if n == "candidates" else "candidate_id", "left_anti") for n, df in tables.items()}
    if "audit_events" in tables and "candidates" in tables:
        found = tables["candidates"].join(gone.withColumnRenamed("candidate_id", "id"), "id", "left_semi").select(F.col("id").alias("candidate_id"), "job_id").distinct()
        rows = audit_rows(found, "candidate_deleted", F.lit("system"), F.struct(F.lit(True).alias("deleted")))
        out["audit_events"] = out["audit_events"].unionByName(rows, allowMissingColumns=True)
    return out


def restore(spark: SparkSession, copy: str, path: str, rows: int | None = None) -> int:
    """A snapshot back to a new place: checked before it gets its name, so a reader sees all of it or none. Returns the number of rows.

    ``path`` must not exist; with ``rows`` the copy must hold that many.
    """
    df = spark.read.parquet(copy)
    staged = f"{path}.staged"
    n = snapshot(df, staged)
    jvm = spark.sparkContext._jvm
    fs_path = jvm.org.apache.hadoop.fs.Path(staged)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    target = jvm.org.apache.hadoop.fs.Path(path)
    if (rows is not None and n != rows) or fs.exists(target) or not fs.rename(fs_path, target):
        fs.delete(fs_path, True)
        raise RuntimeError("the copy could not be restored")
    return n


def migrate(df: DataFrame, steps: Sequence[dict[str, Column]], version: int = 0) -> tuple[DataFrame, int]:
    """``df`` with the columns that the schema steps after ``version`` add (those it has are kept), and the version it then has."""
    for step in steps[version:]:
        df = df.withColumns({name: c for name, c in step.items() if name not in df.columns})
    return df, len(steps)


def verify_export(spark: SparkSession, path: str, columns: Sequence[str], rows: int) -> None:
    """Raise unless the CSV folder ``path`` has exactly ``columns`` in its header and ``rows`` rows."""
    got = spark.read.csv(path, header=True, multiLine=True, escape='"')
    if [c.lstrip("\ufeff") for c in got.columns] != list(columns) or got.count() != rows:
        raise ValueError("the export is not what was asked for")


def snapshot(df: DataFrame, path: str) -> int:
    """Write a new copy of a table, read it again and compare the number of rows; an existing copy is never touched."""
    df.write.mode("errorifexists").parquet(path)
    n = df.sparkSession.read.parquet(path).count()
    if n != df.count():
        raise RuntimeError("the snapshot is incomplete")
    return n
