"""Items of varying length into containers of fixed capacity.

First-fit decreasing, with the containers' free space in a tournament tree: every inner node
holds the larger free space of its two, so the first container that fits is found from the root
in log steps. The items are dealt to groups by hash, and every group is packed on its own, so the
work is spread evenly and a group's size is bounded; what this leaves unused is at most one
container's worth per group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container (from 0) of each item; ``sizes`` descending and none above ``capacity``."""
    n = len(sizes)
    width = 1 << max(0, (n - 1).bit_length())
    free = [capacity] * (2 * width)
    out = np.empty(n, np.int64)
    for k, size in enumerate(sizes.tolist()):
        i = 1
        while i < width:
            i *= 2
            if free[i] < size:
                i += 1
        out[k] = i - width
        free[i] -= size
        i >>= 1
        while i:
            a, b = free[2 * i], free[2 * i + 1]
            top = a if a > b else b
            if free[i] == top:
                break
            free[i] = top
            i >>= 1
    return out


def pack(sizes: DataFrame, capacity: int, ident: str = "doc_id", size: str = "n_tokens", group_items: int = 20_000, items: int | None = None) -> DataFrame:
    """Containers of ``capacity``: container, ``ident``, part, from_token, n_tokens.

    ``sizes`` has one row per item (repeated rows are items of their own). An item above the capacity
    is cut into parts that fill containers of their own and a last part that is packed like an item;
    no other is cut. A null or negative size counts as 0, and items of size 0 share containers with others.
    ``items`` is the number of rows if it is known, which spares a pass over ``sizes``.
    ``group_items`` bounds the items one task packs; ``container`` is unique over all groups.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    groups = max(1, math.ceil((sizes.count() if items is None else items) / group_items))
    n = F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0))
    # equal items are counted before they are numbered: a repeated id is spread, and the file order makes no difference
    equal = sizes.groupBy(F.col(ident), n.alias("__n")).agg(F.count(F.lit(1)).alias("__c"))
    rows = equal.select(F.col(ident), "__n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__c"))).alias("__k")).select(
        F.col(ident), "__n", F.pmod(F.xxhash64(F.col(ident), F.col("__n"), F.col("__k")), F.lit(groups)).cast("int").alias("__g")
    )
    cap = F.lit(capacity).cast("bigint")
    last = F.greatest(F.ceil(F.col("__n") / cap) - 1, F.lit(0)).cast("int")
    parts = rows.select("*", F.explode(F.sequence(F.lit(0), last)).alias("part")).select(
        "__g",
        F.col(ident),
        F.col("part"),
        (F.col("part") * cap).alias("from_token"),
        F.least(F.col("__n") - F.col("part") * cap, cap).alias("n_tokens"),
    )
    kind = parts.schema[ident].dataType.simpleString()
    schema = f"container string, {ident} {kind}, part int, from_token bigint, n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        if not t.num_rows:
            return
        t = t.sort_by([("n_tokens", "descending"), (ident, "ascending"), ("part", "ascending")])
        where = first_fit_decreasing(t["n_tokens"].to_numpy(), capacity)
        name = f"{t['__g'][0].as_py()}-"
        t = t.drop_columns("__g").add_column(0, "container", pa.array(np.char.add(name, where.astype(str)).tolist()))
        yield from t.to_batches()

    return parts.groupBy("__g").applyInArrow(run, schema)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """Containers, tokens, mean fill and the least number of containers that could do."""
    per = packed.groupBy("container").agg(F.sum("n_tokens").alias("used"))
    return per.agg(
        F.count(F.lit(1)).alias("containers"),
        F.sum("used").alias("tokens"),
        F.max("used").alias("fullest"),
        (F.sum("used") / (F.count(F.lit(1)) * F.lit(capacity))).alias("fill"),
        F.ceil(F.sum("used") / F.lit(capacity)).alias("least_containers"),
    )
