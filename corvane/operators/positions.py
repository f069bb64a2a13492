"""Places in a total order per group, for groups of any size.

The rows are range-partitioned and sorted by group and order, so a large group spans several partitions. Each partition
numbers its own rows; where a group goes on, the sizes of its earlier parts are added. The table of these
parts has one row per partition and group that it ends or begins with, not per row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import store


def positions(df: DataFrame, group: str, order: Sequence[Column], name: str = "position") -> DataFrame:
    """``df`` with the place (from 1) of each row within ``group`` by ``order``, a stored table; a null group is one of its own.

    Rows that are equal by ``order`` have different places in no stated sequence, so an order should end with a key.
    """
    keyed = df.withColumn("__g", F.xxhash64(F.col(group).isNull(), F.col(group)))
    by = [F.col("__g"), F.col(group), *order]
    rows = keyed.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__part", F.spark_partition_id())
    kept, at = df.columns, rows.columns.index(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0  # group in hand (its hash and value) and its rows so far
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            value, hashed = b.column(at), b.column(b.num_columns - 2).to_numpy()
            new = np.ones(n, bool)
            same = pc.fill_null(pc.equal(value.slice(1), value.slice(0, n - 1)), True).to_numpy(zero_copy_only=False)
            new[1:] = (hashed[1:] != hashed[:-1]) | ~same
            new[0] = last is None or last != (hashed[0], value[0].as_py())
            start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            local = np.where(start < 0, seen + np.arange(n), np.arange(n) - start)
            last, seen = (hashed[-1], value[-1].as_py()), int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], b.column(b.num_columns - 1), pa.array(local + 1, pa.int64())], [*kept, "__part", name])

    schema = rows.drop("__g").select(*kept, "__part", F.lit(0).cast("bigint").alias(name)).schema
    own = store(rows.mapInArrow(run, schema), "positions")
    parts = own.groupBy(F.col(group).alias("__k"), "__part").agg(F.max(name).alias("n"))
    before = Window.partitionBy("__k").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = parts.withColumn("ahead", F.sum("n").over(before)).where("ahead > 0").select("__k", F.col("__part").alias("__of"), "ahead")  # only groups that span partitions
    joined = own.join(ahead, F.col(group).eqNullSafe(F.col("__k")) & (F.col("__part") == F.col("__of")), "left")
    return joined.select(*kept, (F.col(name) + F.coalesce("ahead", F.lit(0))).alias(name))


def quantiles(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Interpolated quantiles of ``value`` per ``group`` (nulls left out), by places instead of a buffer of values."""
    some = df.select(group, value).where(F.col(value).isNotNull())
    placed = positions(some, group, [F.col(value)], "__i")
    sizes = some.groupBy(F.col(group).alias("__k")).agg(F.count(F.lit(1)).alias("__n"))
    rows = placed.join(sizes, F.col(group).eqNullSafe(F.col("__k")))
    at = {n: (F.col("__n") - 1) * F.lit(float(p)) for n, p in shares.items()}
    near = [F.when(F.col("__i") - 1 == f, F.col(value)) for x in at.values() for f in (F.floor(x), F.ceil(x))]
    wanted = near[0].isNotNull()
    for x in near[1:]:
        wanted = wanted | x.isNotNull()
    ends = [F.max(x).alias(f"__{i}") for i, x in enumerate(near)]
    per = rows.where(wanted).groupBy(group, "__n").agg(*ends)
    out = [(F.col(f"__{2 * i}") + (F.col(f"__{2 * i + 1}") - F.col(f"__{2 * i}")) * (x - F.floor(x))).alias(n) for i, (n, x) in enumerate(at.items())]
    return per.select(group, *out)
