"""The N highest items of every group, by one global sort.

All rows are range-partitioned and sorted on group, score, time and identifier together, so a
group of any size is spread over as many partitions as it fills. Each task walks its sorted
partition once and keeps the first N of every group in it. The kept rows per (group, partition)
are the group's count there, as far as it matters; their prefix sum over the partitions turns the
place within a partition into the exact place within the group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _differs(col: pa.Array, last: pa.Scalar | None) -> np.ndarray:
    """Whether each value differs from the one before it; the first from ``last``. Nulls equal nulls."""
    n = len(col)
    out = np.ones(n, bool)
    if n > 1:
        a, b = col.slice(1), col.slice(0, n - 1)
        same = pc.fill_null(pc.equal(a, b), False)
        out[1:] = ~pc.or_(same, pc.and_(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    if last is not None and n:
        x, y = col[0], last
        out[0] = (x.is_valid != y.is_valid) or (x.is_valid and x.as_py() != y.as_py())
    return out


def top_n(df: DataFrame, group: str, score: str, at: str, ident: str, n: int, partitions: int | None = None) -> DataFrame:
    """``group``, ``ident``, ``score``, ``at`` and ``position`` (from 1) of the first ``n`` of every group.

    Order: score descending, ``at`` ascending (null last), ``ident`` ascending (null last). Rows whose group is
    null, or whose score is null or NaN, are not ranked. Rows equal in all four are copies of one
    item and count once (a null ``ident`` equals a null ``ident``). Groups smaller than ``n`` come out whole.
    """
    # internal names cannot clash with the table's own
    g, s, t, i = (F.col(c).alias(x) for c, x in zip((group, score, at, ident), ("__g", "__s", "__t", "__i"), strict=True))
    rows = df.select(g, (s + F.lit(0.0)).alias("__s"), t, i)  # adding 0.0 makes -0.0 equal 0.0
    rows = rows.where(F.col("__g").isNotNull() & F.col("__s").isNotNull() & ~F.isnan("__s"))
    order = [F.col("__g").asc(), F.col("__s").desc(), F.col("__t").asc_nulls_last(), F.col("__i").asc_nulls_last()]
    spread = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    keys: Sequence[str] = ("__g", "__s", "__t", "__i")
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", __part int, __place int"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last: list[pa.Scalar | None] = [None] * 4
        place = 0  # items of the group in hand seen so far
        for b in batches:
            m = b.num_rows
            if not m:
                continue
            diff = [_differs(c, x) for c, x in zip(b.columns, last, strict=True)]
            new_group = diff[0]
            item = new_group | diff[1] | diff[2] | diff[3]
            run = np.cumsum(item)
            start = np.flatnonzero(new_group)
            offset = np.full(m, place, np.int64)
            if len(start):
                begin = np.repeat(start, np.diff(np.append(start, m)))
                offset[start[0] :] = 1 - run[begin]
            where = run + offset
            place = int(where[-1])
            last = [c[m - 1] for c in b.columns]
            keep = pa.array(np.flatnonzero(item & (where <= n)))
            kept = [c.take(keep) for c in b.columns]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(np.full(len(keep), part, np.int32)), pa.array(where[keep.to_numpy()].astype(np.int32))],
                [*keys, "__part", "__place"],
            )

    local = spread.sortWithinPartitions(*order).mapInArrow(walk, schema)
    earlier = Window.partitionBy("__g").orderBy("__part").rangeBetween(Window.unboundedPreceding, -1)
    exact = local.withColumn("__position", F.col("__place") + F.count(F.lit(1)).over(earlier))
    return exact.where(F.col("__position") <= n).select(
        F.col("__g").alias(group),
        F.col("__i").alias(ident),
        F.col("__s").alias(score),
        F.col("__t").alias(at),
        F.col("__position").cast("int").alias("position"),
    )
