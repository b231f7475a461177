"""Problem 7: filling containers of fixed capacity with texts of varying length.

Method: minimum bin slack. A container starts with the largest remaining item; a subset-sum
dynamic program over bitsets (bit i: a fill of i is possible) finds the multiset of remaining
lengths that comes closest to its capacity; the counts are traced back through the bitsets,
and the container is repeated while its lengths last. Texts larger than a container are cut
at its size; only their last piece is packed with others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
WINDOW_ITEMS = 200_000  # items whose lengths one dynamic program looks at
TASK_CONTAINERS = 512  # containers' worth of tokens that a task is started for


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths (at most counts[length] of each) whose sum is the largest not above room."""
    reach, seen, limit = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if 0 < x <= room), reverse=True):
        before, left, step = reach, min(counts[length], room // length), 1
        seen.append((length, left, before))
        while left:  # 1, 2, 4, ... copies at once: every number up to the count
            take = min(step, left)
            reach |= (reach << (take * length)) & limit
            left -= take
            step *= 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, most, before in reversed(seen):
        for c in range(most + 1):
            if c * length <= at and before >> (at - c * length) & 1:
                if c:
                    chosen[length] = c
                at -= c * length
                break
    return chosen


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Containers for all items: (lengths in the container, how many such containers)."""
    left, out = {k: n for k, n in counts.items() if n}, []
    while left:
        first = max(left)
        left[first] -= 1
        one = fill(left, capacity - first)
        left[first] += 1
        one[first] = one.get(first, 0) + 1
        times = min(left[k] // c for k, c in one.items())
        for k, c in one.items():
            left[k] -= c * times
            if not left[k]:
                del left[k]
        out.append((one, times))
    return out


def _pack(capacity: int, window: int, last: str | None = None):
    """Packs a task's rows in windows. A window's last container goes into the next window; the last of all
    keeps no container, for a packing of the tasks' rests, unless `last` names this one's containers."""

    def emit(ids: list, lengths: list[int], name: str, first: int) -> tuple[pd.DataFrame, int]:
        values, where = np.unique(np.asarray(lengths), return_inverse=True)
        queue = {int(v): iter(np.flatnonzero(where == k).tolist()) for k, v in enumerate(values)}
        at, container, offset = [], [], []
        for one, times in plan({int(v): int((where == k).sum()) for k, v in enumerate(values)}, capacity):
            for _ in range(times):
                pos = 0
                for length, c in sorted(one.items(), reverse=True):
                    for _ in range(c):
                        at.append(next(queue[length]))
                        container.append(f"{name}-{first}")
                        offset.append(pos)
                        pos += length
                first += 1
        return pd.DataFrame({"at": at, "container": container, "container_offset": pd.array(offset, "Int64")}), first

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows, first = [], 0, 0
        from pyspark import TaskContext

        name = last or str(TaskContext.get().partitionId())

        def flush(end: bool = False):
            nonlocal held, rows, first
            p = pd.concat(held, ignore_index=True)
            e, first = emit(None, p["tokens"].tolist(), name, first)
            held, rows = [], 0
            out = p.iloc[e["at"].to_numpy()].reset_index(drop=True).assign(container=e["container"], container_offset=e["container_offset"])
            open_ = (e["container"] == e["container"].iloc[-1]).to_numpy()
            if end and last is None:
                out.loc[open_, ["container", "container_offset"]] = None
            elif not end:
                held = [out.loc[open_, p.columns]]
                out = out[~open_]
            return out

        for p in parts:
            while len(p):
                held.append(p.iloc[: window - rows])
                p = p.iloc[window - rows :]
                rows += len(held[-1])
                if rows >= window:
                    yield flush()
        if held:
            yield flush(True)

    return pack


def pack(sizes: DataFrame, key: str = "doc_id", tokens: str = "n_tokens", capacity: int = CAPACITY, tasks: int | None = None, window: int = WINDOW_ITEMS, settle=None) -> DataFrame:
    """A row per piece of each item: (key, piece, n_pieces, first_token, tokens, container, container_offset).

    An item within the capacity is one piece (whole); a larger one is cut into full pieces,
    each a container of its own, and a rest. Items of size 0 or null have nothing to put
    anywhere: one piece with 0 tokens and no container. Repeated keys are items of their own.
    Container names are unique in the result. No rows: no rows.

    Scale: items are spread by hash of the key over the tasks, so every task sees the same mix
    of lengths; a task packs windows of `window` items (keys and lengths only), and the plan
    works on at most `capacity` lengths, whatever the number of items. There are as many tasks as
    the tokens fill TASK_CONTAINERS containers, at most spark.sql.shuffle.partitions; the last
    container of each is opened again and one task packs what was in them.
    settle: a function that writes the tasks' packing and reads it back; else it is made twice.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    n = F.coalesce(F.col(tokens), F.lit(0)).cast("bigint")
    kind = sizes.schema[key].dataType.simpleString()
    items = sizes.select(F.col(key), n.alias("_n"))
    full = F.when(F.col("_n") > capacity, F.floor(F.col("_n") / capacity)).otherwise(F.lit(0)).cast("bigint")
    rest = F.when(F.col("_n") > capacity, F.col("_n") - full * capacity).otherwise(F.col("_n"))
    items = items.select(key, full.alias("_full"), rest.alias("_rest"))
    pieces = (F.col("_full") + F.when(F.col("_rest") > 0, 1).otherwise(0)).cast("bigint")
    items = items.withColumn("n_pieces", F.greatest(pieces, F.lit(1)))

    whole = items.filter("_full > 0").select(key, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_full") - 1)).alias("piece"), "n_pieces").select(
        key, "piece", "n_pieces", (F.col("piece") * capacity).alias("first_token"), F.lit(capacity).cast("bigint").alias("tokens"),
        F.concat(F.lit("full-"), F.hex(F.xxhash64(F.col(key))), F.lit("-"), F.monotonically_increasing_id()).alias("container"), F.lit(0).cast("bigint").alias("container_offset"),
    )
    empty = items.filter("_full = 0 and _rest = 0").select(
        key, F.lit(0).cast("bigint").alias("piece"), "n_pieces", F.lit(0).cast("bigint").alias("first_token"), F.lit(0).cast("bigint").alias("tokens"),
        F.lit(None).cast("string").alias("container"), F.lit(None).cast("bigint").alias("container_offset"),
    )
    rests = items.filter("_rest > 0").select(
        key, F.col("_full").alias("piece"), "n_pieces", (F.col("_full") * capacity).alias("first_token"), F.col("_rest").alias("tokens"),
    )
    if tasks is None:
        total = rests.agg(F.sum("tokens")).first()[0] or 0
        tasks = max(1, min(int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // (capacity * TASK_CONTAINERS)))
    order = [F.xxhash64(F.col(key)), key, "piece", "n_pieces", "tokens"]  # whole, so that a repeated task gives the same
    schema = f"{key} {kind}, piece bigint, n_pieces bigint, first_token bigint, tokens bigint, container string, container_offset bigint"
    packed = rests.repartition(tasks, F.xxhash64(key, "piece")).sortWithinPartitions(*order).mapInPandas(_pack(capacity, window), schema)
    packed = settle(packed) if settle else packed
    opened = packed.filter("container is null").drop("container", "container_offset")
    last = opened.repartition(1).sortWithinPartitions(*order).mapInPandas(_pack(capacity, window, "last"), schema)
    packed = packed.filter("container is not null").unionByName(last)
    return packed.unionByName(whole).unionByName(empty)


def in_several(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The keys whose pieces lie in more than one container (texts larger than a container)."""
    return packed.groupBy(key).agg(F.min("container").alias("_a"), F.max("container").alias("_b")).filter("_a <> _b").select(key)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, unused tokens and their share, whole and cut items' pieces."""
    each = packed.filter("container is not null").groupBy("container").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("k"), F.max("n_pieces").alias("p"))
    return each.agg(
        F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"),
        F.sum(F.lit(capacity) - F.col("t")).alias("unused_tokens"),
        (F.sum(F.lit(capacity) - F.col("t")) / (F.count(F.lit(1)) * F.lit(float(capacity)))).alias("unused_share"),
        F.max("t").alias("fullest"), F.sum("k").alias("pieces"),
    )
