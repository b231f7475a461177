"""Problem 3: references to records that do not exist.

Method: skew-aware split. A fixed-size sketch names the few keys that carry much of the table;
the first load time of their targets (a row each) is broadcast, and their references are compared
row by row before anything is moved. All references are then pre-aggregated per key and period,
whatever load times they have; the keys that are not heavy meet their targets in a shuffled
join of those states, and the orphans of both sides are united per table and period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAVY_KEYS = 64  # keys at most that are treated as heavy
HEAVY_SHARE = 0.001  # part of all references from which a key is heavy


def period_of(at: Column) -> Column:
    """YYYY-MM of a UTC time; null stays null."""
    return F.date_format(at, "yyyy-MM")


def heavy_keys(refs: DataFrame, keys: list[str]) -> DataFrame:
    """(heavy_hash): the hashes of the (composite) keys with at least HEAVY_SHARE of all rows, by a frequent-items
    sketch of fixed size; HEAVY_KEYS rows at most. Which keys are found changes the plan, never the result."""
    sketch = refs.select(F.xxhash64(*keys).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(h, {HEAVY_KEYS}, 10000)").alias("top"))
    top = sketch.select("n", F.explode("top").alias("t")).filter(F.col("t.count") >= F.greatest(F.lit(2.0), F.col("n") * HEAVY_SHARE))
    return top.select(F.col("t.item").alias("heavy_hash")).filter("heavy_hash is not null")


def _same(keys: list[str], prefix: str) -> Column:
    c = F.lit(True)
    for k in keys:
        c = c & (F.col(k) == F.col(f"{prefix}{k}"))
    return c


def _first_load(targets: DataFrame, keys: list[str], prefix: str, name: str) -> DataFrame:
    """The earliest load of each target key; a target without a load time was always there."""
    always = F.lit("0001-01-01").cast("timestamp_ntz")
    return targets.groupBy(*(F.col(k).alias(f"{prefix}{k}") for k in keys)).agg(F.min(F.coalesce("at", always)).alias(name))


def orphans(refs: DataFrame, targets: DataFrame, keys: list[str], settle=None) -> DataFrame:
    """(*keys, load_month, n_rows): the references, by period, that have no target row loaded by then.

    refs: (*keys, at), one row per referring row; rows that are no references must have been
    left out. targets: (*keys, at), one row per target row that lives.
    Keys are equal as in SQL: a null part matches nothing, so the reference is an orphan.
    A reference is an orphan if no live target exists or the earliest came later than it.
    A reference without a load time is an orphan only if no target exists; its period is null.

    settle: a function that writes the orphans' states and reads them back. It is needed for n_rows: where a key's
    target came in the middle of a period, its references of that period are looked at once more. Without it
    n_rows is left out, and a row tells only that there is an orphan.

    Scale: a heavy key leaves each task as one state per period, and so does any other; a key has no more
    rows in the join than there are periods. No part of it grows with a key's rows.
    """
    heavy = heavy_keys(refs, keys)
    h = F.xxhash64(*keys)
    few = targets.join(F.broadcast(heavy), h == F.col("heavy_hash"), "left_semi")  # HEAVY_KEYS keys at most, but for colliding hashes
    rows = refs.join(F.broadcast(heavy), h == F.col("heavy_hash"), "left").join(F.broadcast(_first_load(few, keys, "_h_", "_known")), _same(keys, "_h_"), "left")
    known_orphan = F.col("heavy_hash").isNotNull() & (F.col("_known").isNull() | F.coalesce(F.col("_known") > F.col("at"), F.lit(False)))
    states = rows.groupBy(*keys, period_of(F.col("at")).alias("load_month")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("at").alias("_lo"), F.max("at").alias("_hi"),
        F.max(F.col("heavy_hash").isNotNull()).alias("_heavy"), F.sum(known_orphan.cast("bigint")).alias("_lost"),
    )
    j = states.join(_first_load(targets, keys, "_t_", "_first"), _same(keys, "_t_"), "left")
    none = F.col("_first").isNull()
    some = F.when(F.col("_heavy"), F.col("_lost") > 0).otherwise(none | F.coalesce(F.col("_lo") < F.col("_first"), F.lit(False)))
    lost = j.filter(some)
    if settle is None:
        return lost.select(*keys, "load_month")
    # rows without a load time are no orphans here: a target exists
    mixed = ~F.col("_heavy") & ~none & (F.col("_hi") >= F.col("_first"))
    plain = F.when(F.col("_heavy"), F.col("_lost")).when(none | (F.col("_hi") < F.col("_first")), F.col("_n"))
    lost = settle(lost.select(*keys, "load_month", "_first", plain.alias("n_rows"), F.coalesce(mixed, F.lit(False)).alias("_mixed")))
    again = lost.filter("_mixed").select(*(F.col(k).alias(f"_m_{k}") for k in keys), F.col("load_month").alias("_month"), "_first")
    seen = refs.join(again, _same(keys, "_m_") & (period_of(F.col("at")) == F.col("_month")) & (F.col("at") < F.col("_first")))
    counted = seen.groupBy(*keys, F.col("_month").alias("load_month")).agg(F.count(F.lit(1)).alias("n_rows"))
    return lost.filter("not _mixed").select(*keys, "load_month", "n_rows").unionByName(counted)


def orphan_report(found: dict[str, tuple[DataFrame, DataFrame]], ref_key: dict[str, str]) -> DataFrame:
    """(table_name, load_month, n_references, orphan_keys, orphan_rows) from, by table, its
    references (with at) and orphans(). Months without any orphan have zeros."""
    out = None
    for name, (refs, lost) in found.items():
        all_ = refs.groupBy(period_of(F.col("at")).alias("load_month")).agg(F.count(F.lit(1)).alias("n_references"))
        per_key = lost.groupBy("load_month", F.col(ref_key[name]).alias("k")).agg(F.sum("n_rows").alias("n"))
        lost_ = per_key.groupBy(F.col("load_month").alias("_m")).agg(F.count(F.lit(1)).alias("orphan_keys"), F.sum("n").alias("orphan_rows"))
        one = all_.join(lost_, F.col("load_month").eqNullSafe(F.col("_m")), "left").select(
            F.lit(name).alias("table_name"), "load_month", "n_references",
            F.coalesce("orphan_keys", F.lit(0)).alias("orphan_keys"), F.coalesce("orphan_rows", F.lit(0)).alias("orphan_rows"),
        )
        out = one if out is None else out.unionByName(one)
    return out
