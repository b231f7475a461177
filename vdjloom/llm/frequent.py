"""Problem 1: the most frequent items among billions of rows, in bounded memory.

Method: external sort with run-length counting. Every task turns its rows into sorted runs
whose equal values are already counted together, the runs are range-partitioned by value,
each range merges its runs in an external (spilling) sort; one stream over the sorted rows adds up
equal neighbours and keeps the k heaviest values in a bounded heap. The ranges' heaps meet in a tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RUN_ROWS = 250_000  # rows that one run counts together before it is sent on
FAN_IN = 32  # heaps that one node of the tree joins

_RUN = "value string, weight bigint, n_rows bigint"
_HEAP = "value string, weight bigint, n_rows bigint, range_weight decimal(38,0), range_rows bigint"


def _counted(tables: list[pa.RecordBatch]) -> pa.Table:
    """One sorted run: equal values counted together."""
    t = pa.Table.from_batches(tables)
    g = t.group_by("value").aggregate([("weight", "sum"), ("n_rows", "sum")])
    g = g.select(["value", "weight_sum", "n_rows_sum"]).rename_columns(["value", "weight", "n_rows"])
    return g.sort_by("value")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= RUN_ROWS:
            yield from _counted(held).to_batches()
            held, rows = [], 0
    if held:
        yield from _counted(held).to_batches()


class _Heap:
    """The k heaviest values seen, and the weight and rows of all."""

    def __init__(self, k: int):
        self.k, self.best, self.weight, self.rows = k, None, 0, 0

    def add(self, t: pa.Table) -> None:
        if t.num_rows:
            t = t if self.best is None else pa.concat_tables([self.best, t])
            keep = pc.select_k_unstable(t, k=min(self.k, t.num_rows), sort_keys=[("weight", "descending"), ("value", "ascending")])
            self.best = t.take(keep).combine_chunks()

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.best is not None:
            n = self.best.num_rows
            total = pa.array([self.weight] + [0] * (n - 1), pa.decimal128(38, 0))
            count = pa.array([self.rows] + [0] * (n - 1), pa.int64())
            yield from self.best.append_column("range_weight", total).append_column("range_rows", count).to_batches()


def _merge_runs(k: int):
    """Equal neighbours of a sorted range added up, also across batches, into a bounded heap."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap, open_ = _Heap(k), None  # the last value may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            heap.weight += pc.sum(b.column("weight")).as_py()
            heap.rows += pc.sum(b.column("n_rows")).as_py()
            t = pa.Table.from_batches([b])
            t = (t if open_ is None else pa.concat_tables([open_, t])).combine_chunks()
            v = t.column("value").combine_chunks()
            start = np.flatnonzero(np.concatenate(([True], np.asarray(pc.not_equal(v[1:], v[:-1])))))
            sums = [np.add.reduceat(np.asarray(t.column(c)), start) for c in ("weight", "n_rows")]
            t = pa.table({"value": v.take(pa.array(start)), "weight": sums[0], "n_rows": sums[1]})
            open_ = t.slice(t.num_rows - 1).combine_chunks()
            heap.add(t.slice(0, t.num_rows - 1))
        if open_ is not None:
            heap.add(open_)
        yield from heap.batches()

    return merge


def _join_heaps(k: int):
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap = _Heap(k)
        for b in batches:
            if b.num_rows:
                heap.weight += int(pc.sum(b.column("range_weight")).as_py())
                heap.rows += pc.sum(b.column("range_rows")).as_py()
                heap.add(pa.Table.from_batches([b]).select(["value", "weight", "n_rows"]))
        yield from heap.batches()

    return join


def frequent_items(df: DataFrame, value: str, weight: str | None = None, k: int = 1000, ranges: int | None = None) -> DataFrame:
    """The k values with the most weight: (value, weight, n_rows, share, rank).

    df: any columns; value is read as a string, null values and null weights are left out,
    weight must not be negative (a row counts 1 without one). share is the part of all
    counted weight. Weights that come out are exact: a value's runs all meet in one range,
    and no value outside its range's k heaviest can be among the k heaviest of all. On
    ties the smaller value comes first (plain string order). Empty input: no rows.

    Memory: a task holds RUN_ROWS rows, then a batch and k values; the sort spills. Skew: a value that
    fills a third of the table leaves each task as one row per run, so it never makes a
    large range. A node of the tree reads FAN_IN * k rows; a value's weights must add up to less than 2^63.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    w = F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint")
    rows = df.select(F.col(value).cast("string").alias("value"), w.alias("weight"), F.lit(1).cast("bigint").alias("n_rows"))
    rows = rows.filter(F.col("value").isNotNull() & F.col("weight").isNotNull())
    runs = rows.mapInArrow(_runs, _RUN)
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heaps = runs.repartitionByRange(n, "value").sortWithinPartitions("value").mapInArrow(_merge_runs(k), _HEAP)
    while n > 1:
        n = -(-n // FAN_IN)
        heaps = heaps.repartition(n).mapInArrow(_join_heaps(k), _HEAP)
    whole = Window.partitionBy()  # the last heap: k rows at most
    order = Window.orderBy(F.desc("weight"), F.asc("value"))
    return (
        heaps.withColumn("total", F.sum("range_weight").over(whole))
        .withColumn("rank", F.row_number().over(order))
        .select(
            "value", "weight", "n_rows",
            F.when(F.col("total") > 0, F.col("weight").cast("double") / F.col("total").cast("double")).alias("share"),
            F.col("total").alias("total_weight"), "rank",
        )
    )
