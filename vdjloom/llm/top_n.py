"""Problem 2: the N best items of every group, also where a group holds millions of items.

Method: sorted-run loser-tree merge. Scores are added up per (group, item); every partition
of that result is a bucket, sorted by group, score and item: a sorted run, of which only the
first N items of a group can matter. The runs go to the group's reducer, where a loser tree
merges a group's runs, stops after N outputs and seeks to the next group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OUT = "group_key string, item_key string, score decimal(38,0), n_rows bigint, rank int"


class LoserTree:
    """Merges sorted sequences: the root is the least head of all; after the winner moves
    on, only its path to the root is played again (log2 of the number of runs)."""

    def __init__(self, runs: list[list]):
        self.runs = runs
        self.at = [0] * len(runs)
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.loser = [-1] * self.size
        winners = [-1] * self.size + [i if i < len(runs) else -1 for i in range(self.size)]
        for node in range(self.size - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.loser[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if self.size > 1 else winners[self.size]

    def _head(self, run: int):
        return self.runs[run][self.at[run]] if run >= 0 and self.at[run] < len(self.runs[run]) else None

    def _before(self, a: int, b: int) -> bool:
        x, y = self._head(a), self._head(b)
        return y is None if x is None else y is None or x <= y

    def pop(self):
        """The next item in order, or None."""
        item = self._head(self.winner)
        if item is None:
            return None
        self.at[self.winner] += 1
        w, node = self.winner, (self.winner + self.size) // 2
        while node >= 1:
            if not self._before(w, self.loser[node]):
                w, self.loser[node] = self.loser[node], w
            node //= 2
        self.winner = w
        return item


def _merge(n: int):
    """Input: rows sorted by group, run and position. One group's rows are at most
    n of each run; they are held until the group ends."""

    def best(key, rows: list[tuple]) -> list[tuple]:
        runs: dict[int, list] = {}
        for run, score, item, count in rows:
            # a null item sorts first, as in the runs themselves
            runs.setdefault(run, []).append((-score, item is not None, item or "", count))
        tree, out = LoserTree(list(runs.values())), []
        while len(out) < n and (x := tree.pop()) is not None:
            out.append((key, x[2] if x[1] else None, -x[0], x[3], len(out) + 1))
        return out

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("group_key", pa.string()), ("item_key", pa.string()), ("score", pa.decimal128(38, 0)), ("n_rows", pa.int64()), ("rank", pa.int32())])
        key, held, started = None, [], False
        for b in batches:
            out = []
            g = b.column("group_key").to_pylist()
            cols = [b.column(c).to_pylist() for c in ("run", "score", "item_key", "n_rows")]
            edges = [0, *(np.flatnonzero([x != y for x, y in zip(g[1:], g[:-1])]) + 1).tolist(), len(g)] if g else []
            for lo, hi in zip(edges[:-1], edges[1:]):
                if not started or g[lo] != key:
                    out += best(key, held) if started else []
                    key, held, started = g[lo], [], True
                held += zip(*(c[lo:hi] for c in cols))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
        if started:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*best(key, held)), schema)], schema=schema)

    return merge


def top_n(df: DataFrame, group: str, item: str, score: str, n: int = 10) -> DataFrame:
    """Per group the n items with the largest summed score: (group_key, item_key, score, n_rows, rank).

    Groups and items are read as strings; null is a group (an item) of its own. Null scores
    count as no score: the row is left out. Ties: the smaller item first (plain string order,
    null first), so the result is the same on every run. Groups with fewer items give all.
    Repeated rows add up. Empty input: no rows.

    Scale: the sums combine map-side and are shuffled by (group, item), so a group with a
    third of all rows is spread over all tasks; after each run keeps n items of a group, a
    group sends at most n * runs rows to its reducer.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    rows = df.select(F.col(group).cast("string").alias("group_key"), F.col(item).cast("string").alias("item_key"), F.col(score).cast("bigint").alias("s"))
    sums = rows.filter(F.col("s").isNotNull()).groupBy("group_key", "item_key").agg(F.sum(F.col("s").cast("decimal(28,0)")).alias("score"), F.count(F.lit(1)).alias("n_rows"))
    # one run per bucket: the window is over the run itself, so it needs no exchange by group
    runs = sums.withColumn("run", F.spark_partition_id())
    runs = _first_of_run(runs, n)
    at_group = runs.repartition("group_key").sortWithinPartitions("group_key", "run", F.desc("score"), F.asc("item_key"))
    return at_group.select("group_key", "run", F.col("score").cast("decimal(38,0)").alias("score"), "item_key", "n_rows").mapInArrow(_merge(n), _OUT)


def _first_of_run(runs: DataFrame, n: int) -> DataFrame:
    """The first n items of each group of a sorted run; the rest is skipped."""

    def skip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seen, begun = None, 0, False
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column("group_key").dictionary_encode()
            codes = np.asarray(g.indices.fill_null(-1))
            start = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
            pos = np.arange(len(codes)) - np.repeat(start, np.diff(np.append(start, len(codes))))
            first = b.column("group_key")[0].as_py()
            if begun and first == key:
                pos[: start[1] if len(start) > 1 else len(codes)] += seen
            key, seen, begun = b.column("group_key")[b.num_rows - 1].as_py(), int(pos[-1]) + 1, True
            keep = np.flatnonzero(pos < n)
            if len(keep):
                yield b.take(pa.array(keep))

    cols = "group_key string, item_key string, score decimal(38,0), n_rows bigint, run int"
    ordered = runs.sortWithinPartitions("group_key", F.desc("score"), F.asc("item_key"))
    return ordered.select("group_key", "item_key", "score", "n_rows", "run").mapInArrow(skip, cols)
