"""Problem 5: distinct counts of sets too large to hold, with a known error and mergeable parts.

Method: linear counting. Each identifier is hashed to one bit of a fixed bitmap of m bits;
bitmaps of parts merge by bitwise union; the count is estimated from the fraction of empty bits as
-m ln(empty / m). m is chosen for the target error.

A bitmap is kept as its words of 64 bits that have any bit set: a set of few identifiers is as many
words, however large m is, and a large one is spread over tasks by its words. All of it runs in
hash aggregates (bit_or, bit_count) in generated code.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_BITS = 32_768
LEAST_MAX = 1e6  # identifiers that bitmaps sized by a table's rows allow for at least
SURE = 6.0  # standard errors (and identifiers) by which a decision must lie off its border
SMALL_KEYS = 100_000  # keys up to which those to be counted exactly are broadcast


def standard_error(n: float, m: int) -> float:
    """Relative standard error of the estimate of n identifiers in m bits:
    sqrt(m (e^t - t - 1)) / n with t = n / m (linear counting)."""
    t = n / m
    return math.sqrt(m * (math.exp(t) - t - 1)) / n if n else 0.0


def bits_for(n_max: float, error: float) -> int:
    """The size of bitmap with which up to n_max identifiers are counted within the given
    relative standard error and the bitmap practically never fills (load of 8 at most)."""
    if not 0 < error < 1:
        raise ValueError("error must lie between 0 and 1")
    m = LEAST_BITS
    while n_max / m > 8 or standard_error(n_max, m) > error:
        m *= 2
    return m


def sketch(df: DataFrame, keys: list[str], value: str, m: int = LEAST_BITS) -> DataFrame:
    """Mergeable parts: (*keys, word, bits, n_rows), one row per key and word that has any bit.

    Null values are not counted and give no row; null keys are keys. Repeated rows set the
    same bit. Map-side, a hot key is m / 64 words per task at most, whatever its rows.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.pmod(F.xxhash64(F.col(value)), F.lit(m)).alias("_bit"))
    rows = rows.select(*keys, F.shiftright("_bit", 6).alias("word"), F.expr("shiftleft(1L, cast(_bit % 64 as int))").alias("_one"))
    return rows.groupBy(*keys, "word").agg(F.bit_or("_one").alias("bits"), F.count(F.lit(1)).alias("n_rows"))


def merge(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Union of parts, rolled up to fewer keys: the bitwise or of their bitmaps."""
    return parts.groupBy(*keys, "word").agg(F.bit_or("bits").alias("bits"), F.sum("n_rows").alias("n_rows"))


def estimate(parts: DataFrame, keys: list[str], m: int) -> DataFrame:
    """(*keys, n_rows, set_bits, estimate, std_error): the estimate of each key's distinct
    values and its relative standard error. set_bits never exceeds the true count. Where every
    bit is set the count is beyond what the bitmap can tell: estimate and std_error are null."""
    whole = parts.groupBy(*keys).agg(F.sum(F.bit_count("bits")).cast("bigint").alias("set_bits"), F.sum("n_rows").cast("bigint").alias("n_rows"))
    empty = F.when(F.col("set_bits") < m, F.lit(m) - F.col("set_bits"))
    n: Column = -F.lit(float(m)) * F.log(empty / F.lit(float(m)))
    t = n / F.lit(float(m))
    err = F.when(n > 0, F.sqrt(F.lit(float(m)) * (F.exp(t) - t - 1)) / n).when(n <= 0, F.lit(0.0))
    return whole.select(*keys, "n_rows", "set_bits", n.alias("estimate"), err.alias("std_error"))


def _bits_of(df: DataFrame, value: str, error: float, n_max: float | None) -> int:
    return bits_for(max(LEAST_MAX, df.filter(F.col(value).isNotNull()).count()) if n_max is None else n_max, error)


def groupings(dims: list[str]) -> list[list[str]]:
    """Every subset of the dimensions, the largest first."""
    return [list(keep) for r in range(len(dims), -1, -1) for keep in combinations(dims, r)]


def distinct_counts(df: DataFrame, dims: list[str], value: str, error: float = 0.02, n_max: float | None = None, settle=None) -> DataFrame:
    """Estimated distinct values for every combination of the dimensions: one row per value
    of each subset of dims, with grouping = the names of that subset ('' for the whole).

    The parts of the full combination are built from the rows once; every other combination
    is merged from one that has a dimension more. settle: a function that writes the parts and reads them back.
    n_max: the most distinct values the error holds for; by default the rows with a value (counted
    first, and never fewer than the distinct values), or LEAST_MAX if that is more.
    Columns: grouping, *dims (null where rolled up or null itself), n_rows, set_bits, estimate, std_error.
    """
    m = _bits_of(df, value, error, n_max)
    parts = sketch(df, dims, value, m)
    levels: dict[tuple, DataFrame] = {}
    out = None
    for keep in groupings(dims):
        if len(keep) == len(dims):
            level = settle(parts) if settle else parts
        else:
            more = next(d for d in reversed(dims) if d not in keep)
            level = merge(levels[tuple(d for d in dims if d in keep or d == more)], keep)
        levels[tuple(keep)] = level
        e = estimate(level, keep, m).select(
            F.lit(",".join(keep)).alias("grouping"),
            *(F.col(d) if d in keep else F.lit(None).cast(df.schema[d].dataType).alias(d) for d in dims),
            "n_rows", "set_bits", "estimate", "std_error",
        )
        out = e if out is None else out.unionByName(e)
    return out


def strongly_repeating(
    df: DataFrame, keys: list[str], value: str, least_rows: int = 20, num: int = 5, den: int = 2, error: float = 0.02, n_max: float | None = None, settle=None
) -> DataFrame:
    """The keys with least_rows rows or more in which num * distinct < den * rows:
    (*keys, n_rows, estimate, std_error). Null values are left out, null keys are keys.

    The bitmaps decide: a key whose estimate lies off the border by SURE standard errors and SURE identifiers is in or
    out (the chance of an error is below 1e-8 a key; set_bits, which is never above the true count, puts a
    key out for certain). Only keys whose interval holds the border are counted exactly, and keys whose bitmap is full.
    settle: a function that writes the estimates and reads them back; else they are made twice.
    """
    m = _bits_of(df, value, error, n_max)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, value)
    e = estimate(sketch(rows, keys, value, m), keys, m).filter(F.col("n_rows") >= least_rows)
    off = F.lit(SURE) * F.col("std_error") * F.col("estimate") + F.lit(SURE)
    least = F.greatest(F.col("set_bits").cast("double"), F.col("estimate") - off)  # nulls are passed over
    most = F.least(F.col("n_rows").cast("double"), F.col("estimate") + off)
    e = e.select(
        *keys, "n_rows", "estimate", "std_error",
        F.when(most * num < F.col("n_rows") * den, "in").when(least * num < F.col("n_rows") * den, "near").otherwise("out").alias("_side"),
    ).filter("_side <> 'out'")
    e = settle(e) if settle else e
    near = e.filter("_side = 'near'").select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("n_rows").alias("_n_rows"), "estimate", "std_error")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    if near.limit(SMALL_KEYS + 1).count() <= SMALL_KEYS:  # the size check of the broadcast
        held = rows.join(F.broadcast(near), same, "inner").groupBy(*keys, value, "_n_rows", "estimate", "std_error").agg(F.lit(1).alias("_1"))
    else:
        held = rows.groupBy(*keys, value).agg(F.lit(1).alias("_1")).join(near, same, "inner")
    exact = held.groupBy(*keys, F.col("_n_rows").alias("n_rows"), "estimate", "std_error").agg(F.count(F.lit(1)).alias("_distinct"))
    cols = [*keys, "n_rows", "estimate", "std_error"]
    return e.filter("_side = 'in'").select(*cols).unionByName(exact.filter(F.col("_distinct") * num < F.col("n_rows") * den).select(*cols))


def outside(df: DataFrame, dims: list[str], value: str, counts: DataFrame, settle=None) -> DataFrame:
    """How distinct_counts() fared against exact counts: per grouping its sets, the exact distinct values of all of them, and
    the sets whose estimate is off by more than SURE standard errors and SURE identifiers: (grouping, n_sets, n_distinct, n_outside).
    settle: a function that writes the distinct values and reads them back; else they are made for each grouping."""
    once = df.filter(F.col(value).isNotNull()).select(*dims, value).distinct()
    once = settle(once) if settle else once
    out = None
    for keep in groupings(dims):
        exact = once.select(*keep, value).distinct().groupBy(*(F.col(d).alias(f"_{d}") for d in keep)).agg(F.count(F.lit(1)).alias("_exact"))
        same = F.lit(True)
        for d in keep:
            same = same & F.col(d).eqNullSafe(F.col(f"_{d}"))
        j = counts.filter(F.col("grouping") == ",".join(keep)).join(exact, same, "full")
        off = F.abs(F.col("estimate") - F.col("_exact")) > F.lit(SURE) * F.col("std_error") * F.col("_exact") + F.lit(SURE)
        g = j.groupBy(F.lit(",".join(keep)).alias("grouping")).agg(F.count(F.lit(1)).alias("n_sets"), F.sum("_exact").alias("n_distinct"), F.sum(F.coalesce(off, F.lit(True)).cast("bigint")).alias("n_outside"))
        out = g if out is None else out.unionByName(g)
    return out
