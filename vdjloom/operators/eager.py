"""Problem 4: a few keys holding most records.

Method: eager aggregation through joins. Both inputs are aggregated by the join key before
they meet, so a key is one compact state on either side, however many rows it has; the
states are joined, and what the join of the rows would have given is computed from them:
counts multiply, sums are multiplied by the other side's count. Then it is rolled up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def eager_join(
    left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, sums_left: dict[str, Column] | None = None,
    sums_right: dict[str, Column] | None = None, carry: list[str] | None = None, n: str = "n",
) -> DataFrame:
    """Per key of left (and per value of the `carry` columns of left) the aggregates of
    left LEFT JOIN right on the keys, without making the joined rows.

    Columns: key_value, *carry, {n}_left and {n}_right (rows of the key on either side),
    joined_rows (what an inner join would have), and for each named sum its own value and
    joined_<name>, its sum over the inner join's rows. Null keys are a key of their own that
    matches nothing. Nulls add nothing to sums; a sum of no value is null, its joined form too.
    Sums of whole numbers are multiplied as whole numbers of up to 38 digits, others in their own type.

    Scale: both group-bys combine map-side, so a key with a third of all rows is one row per
    task in the shuffle, and one row in the join.
    """
    carry = carry or []
    a = left.groupBy(left_key.alias("key_value"), *carry).agg(
        F.count(F.lit(1)).alias(f"{n}_left"), *(F.sum(c).alias(k) for k, c in (sums_left or {}).items())
    )
    b = right.filter(right_key.isNotNull()).groupBy(right_key.alias("_key")).agg(
        F.count(F.lit(1)).alias("_n"), *(F.sum(c).alias(k) for k, c in (sums_right or {}).items())
    )
    joined = a.join(b, F.col("key_value") == F.col("_key"), "left")
    nr = F.coalesce("_n", F.lit(0)).cast("bigint")
    wide = "decimal(38,0)"
    out = [F.col("key_value"), *(F.col(c) for c in carry), F.col(f"{n}_left"), nr.alias(f"{n}_right")]
    out.append((F.col(f"{n}_left").cast("decimal(19,0)") * nr.cast("decimal(19,0)")).cast(wide).alias("joined_rows"))

    def times(k: str, rows: Column) -> Column:
        if isinstance(joined.schema[k].dataType, T.IntegralType):
            return (F.col(k).cast("decimal(19,0)") * rows.cast("decimal(19,0)")).cast(wide)
        return F.col(k) * rows.cast("decimal(19,0)")

    out += [c for k in sums_left or {} for c in (F.col(k), times(k, nr).alias(f"joined_{k}"))]
    out += [c for k in sums_right or {} for c in (F.col(k), times(k, F.col(f"{n}_left")).alias(f"joined_{k}"))]
    return joined.select(*out)


def roll_up(states: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """States added up to fewer keys."""
    return states.groupBy(*keys).agg(*(F.sum(s).alias(s) for s in sums))


def share_of_rows(states: DataFrame, rows: DataFrame, n: str = "n_left") -> DataFrame:
    """states with row_share, the key's part of all rows of the table as delivered."""
    total = rows.agg(F.count(F.lit(1))).scalar()
    return states.withColumn("total_rows", total).withColumn("row_share", F.col(n) / F.col("total_rows"))


def heavy(states: DataFrame, num: int = 1, den: int = 50, n: str = "n_left") -> DataFrame:
    """The non-null keys with at least num/den of all rows (in whole numbers, so the border is exact)."""
    return states.filter(F.col("key_value").isNotNull() & (F.col(n) * den >= F.col("total_rows") * num))
