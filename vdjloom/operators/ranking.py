"""Ranks, running sums, pages and other ordered operators (R, L)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vdjloom.plans.durable import settle


def running(df: DataFrame, group: list[str], order: list[Column], value: str, rank: str = "rank", total: str = "running", whole: str | None = None) -> DataFrame:
    """df with each row's position in its group's order and the sum of `value` up to it (and, as
    `whole`, over the whole group), where groups may be of any size: no task holds a whole group.

    The rows are range-partitioned by group and order and sorted; one stream over each partition numbers
    and sums its part of every group, and what it made is written once, so every later step sees the same
    partitions. Only a partition's first group can have begun in an earlier one: the shift is one row per
    partition at most, which is broadcast. Rows that tie in `order` may change places; give every
    column that must be fixed. Null values count as 0. Whole numbers stay whole, others are doubles.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = [F.col(g) for g in group]
    integral = isinstance(df.schema[value].dataType, T.IntegralType)
    kind = "bigint" if integral else "double"
    by = [*key, *order]
    rows = df.withColumns({"__part": F.lit(0), "__v": F.coalesce(F.col(value).cast(kind), F.lit(0).cast(kind))})
    rows = rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("__part", F.spark_partition_id())
    schema = T.StructType([*(f for f in rows.schema if f.name != "__v"), T.StructField("__n", T.LongType()), T.StructField("__s", T.LongType() if integral else T.DoubleType())])
    done = settle(rows.mapInArrow(_number(group), schema))
    sizes = done.groupBy(*group, "__part").agg(F.max("__n").alias("__rows"), F.max_by("__s", "__n").alias("__sum"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(
        *(F.col(g).alias(f"__g_{g}") for g in group), F.col("__part").alias("__p"), F.sum("__rows").over(before).alias("__rows_before"), F.sum("__sum").over(before).alias("__sum_before")
    ).filter("__rows_before > 0")

    def same(prefix: str) -> Column:
        c = F.lit(True)
        for g in group:
            c = c & F.col(g).eqNullSafe(F.col(f"{prefix}{g}"))
        return c

    j = done.join(F.broadcast(shift), (F.col("__part") == F.col("__p")) & same("__g_"), "left")
    extra = []
    if whole:
        sums = sizes.groupBy(*(F.col(g).alias(f"__w_{g}") for g in group)).agg(F.sum("__sum").alias("__whole"))
        j, extra = j.join(sums, same("__w_")), [F.col("__whole").alias(whole)]
    shifted = lambda c, b: F.col(c) + F.coalesce(F.col(b), F.lit(0))
    return j.select(*(F.col(f"`{c}`") for c in df.columns), shifted("__n", "__rows_before").alias(rank), shifted("__s", "__sum_before").alias(total), *extra)


def _number(group: list[str]):
    """Positions and running sums within the groups of one sorted partition, batch by batch."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, s = None, 0, 0
        for b in batches:
            size = b.num_rows
            if not size:
                continue
            new = np.zeros(size, bool)
            new[0] = last is None or last != tuple(b.column(g)[0].as_py() for g in group)
            for g in group:
                c = b.column(g)
                x, y = c[1:], c[:-1]
                equal = pc.or_kleene(pc.equal(x, y), pc.and_(pc.is_null(x), pc.is_null(y)))
                new[1:] |= ~np.asarray(pc.fill_null(equal, False))
            start = np.flatnonzero(new)
            goes_on = not new[0]
            if goes_on:
                start = np.concatenate(([0], start))
            length = np.diff(np.append(start, size))
            v = np.asarray(b.column("__v"))
            run = np.cumsum(v)
            run = run - np.repeat(run[start] - v[start], length)
            pos = np.arange(1, size + 1) - np.repeat(start, length)
            if goes_on:
                pos[: length[0]] += n
                run[: length[0]] += s
            last, n, s = tuple(b.column(g)[size - 1].as_py() for g in group), pos[-1], run[-1]
            keep = [i for i, f in enumerate(b.schema) if f.name != "__v"]
            arrays = [*(b.column(i) for i in keep), pa.array(pos, pa.int64()), pa.array(run)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*(b.schema.field(i).name for i in keep), "__n", "__s"])

    return number


def best_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order. Spark keeps one row per key and
    task before the exchange (window group limit), so hot keys stay small."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def replace_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace the old rows of the same keys; other old rows stay."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def keyset_page(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """The next `size` rows by key after a value, with has_more (size + 1 rows are looked at)."""
    rows = df if after is None else df.filter(F.col(key) > F.lit(after))
    few = rows.orderBy(key).limit(size + 1)
    w = Window.orderBy(key)
    return few.withColumn("_n", F.row_number().over(w)).withColumn("has_more", F.max("_n").over(Window.partitionBy()) > size).filter(F.col("_n") <= size).drop("_n")


def offset_page(df: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    """Rows offset+1 to offset+size in the order; size is kept within 1 and 200."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(200, max(1, size)))


def page_number(df: DataFrame, group: list[str], order: list[Column], size: int) -> DataFrame:
    """The page each row is shown on, counted from 0."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("page", F.floor((F.row_number().over(w) - 1) / F.lit(size)))


def search(df: DataFrame, text: str, columns: list[str] | None = None) -> DataFrame:
    """rows in which any column contains the text, upper and lower case being one."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns or df.columns]
    return df.filter(F.contains(F.lower(F.concat_ws(" ", *cols)), F.lower(F.lit(text))))


def sequential_ids(df: DataFrame, order: list[Column], first: int = 1, name: str = "new_id") -> DataFrame:
    """Df with consecutive ids from `first` on, in the given order; no task holds the whole table (see running())."""
    one = df.withColumn("_one", F.lit(1).cast("bigint")).withColumn("_all", F.lit(0))
    return running(one, ["_all"], order, "_one", name, "_sum").withColumn(name, F.col(name) + (first - 1)).drop("_one", "_all", "_sum")


def add_counts(old: DataFrame, new: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """Counters brought up to date: the new counts added to the old ones of their keys."""
    return old.select(*keys, count).unionByName(new.select(*keys, count)).groupBy(*keys).agg(F.sum(count).alias(count))
