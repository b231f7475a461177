from datetime import datetime, timedelta

from vdjloom.operators import references
from vdjloom.plans.durable import settle

T0 = datetime(2026, 1, 31, 12)


def find(spark, refs, targets, keys=("k",), write=settle):
    cols = "".join(f"{k} string, " for k in keys)
    r = spark.createDataFrame(refs, cols + "at timestamp_ntz")
    t = spark.createDataFrame(targets, cols + "at timestamp_ntz")
    return sorted(tuple(x) for x in references.orphans(r, t, list(keys), write).collect())


def brute(refs, targets):
    first, out = {}, {}
    for *k, at in targets:
        if None not in k:
            first[tuple(k)] = min(first.get(tuple(k), at), at)
    for *k, at in refs:
        if tuple(k) not in first or first[tuple(k)] > at:
            m = (*k, at.strftime("%Y-%m"))
            out[m] = out.get(m, 0) + 1
    return sorted((*k, n) for k, n in out.items())


def test_missing_late_and_hot_keys(spark):
    day = timedelta(days=1)
    refs = [("hot", T0)] * 400 + [("hot", T0 + 9 * day)] * 300 + [("gone", T0)] * 350 + [(f"k{i}", T0 + (i % 5) * day) for i in range(200)]
    targets = [("hot", T0 + 3 * day), ("hot", T0 + 5 * day)] + [(f"k{i}", T0 + (i % 7) * day) for i in range(150)]
    assert references.heavy_keys(spark.createDataFrame(refs, "k string, at timestamp_ntz"), ["k"]).count() == 2
    assert find(spark, refs, targets) == brute(refs, targets)
    assert find(spark, refs, targets, write=None) == [x[:-1] for x in brute(refs, targets)]


def test_hot_composite_key_and_times_within_a_month(spark):
    """A key of two parts with a third of the rows, all at times of their own, whose target comes in the middle of a month."""
    minute = timedelta(minutes=1)
    hot = [("h", "s", T0 + i * minute) for i in range(3000)]
    rest = [(f"k{i % 900}", "s" if i % 2 else "r", T0 + i * 7 * minute) for i in range(6000)]
    targets = [("h", "s", T0 + 1234 * minute + timedelta(seconds=30)), ("h", "r", T0)] + [(f"k{i}", "s" if i % 3 else "r", T0 + (i * 47) * minute) for i in range(800)]
    assert references.heavy_keys(spark.createDataFrame(hot + rest, "k string, s string, at timestamp_ntz"), ["k", "s"]).count() >= 1
    assert find(spark, hot + rest, targets, ("k", "s")) == brute(hot + rest, targets)


def test_no_exchange_carries_a_hot_key_row_by_row(spark):
    """The rows of one key are one state per task and period when they are moved, with broadcasts of targets off, too."""
    from pyspark.sql import functions as F

    r = spark.range(0, 30000, 1, 4).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"), F.lit("s").alias("s"), F.timestamp_micros(F.col("id") * 1000000).cast("timestamp_ntz").alias("at"))
    none = r.filter("k = 'none'")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lost = references.orphans(r, none, ["k", "s"], settle)
        assert lost.filter("k = 'hot'").agg(F.sum("n_rows")).first()[0] == 10000
        plan = references.orphans(r, none, ["k", "s"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("BroadcastHashJoin") >= 3  # the heavy keys, their targets, and which targets those are


def test_rows_without_time(spark):
    refs, targets = [("a", None), ("b", None), ("c", T0)], [("a", T0), ("c", None)]
    assert find(spark, refs, targets) == [("b", None, 1)]


def test_empty_tables(spark):
    assert find(spark, [], [("a", T0)]) == []
    assert find(spark, [("a", T0)], []) == [("a", "2026-01", 1)]


def test_null_parts_match_nothing(spark):
    r = spark.createDataFrame([("a", None, T0), ("a", "s", T0)], "k string, s string, at timestamp_ntz")
    t = spark.createDataFrame([("a", None, T0), ("a", "s", T0)], "k string, s string, at timestamp_ntz")
    got = references.orphans(r, t, ["k", "s"]).collect()
    assert [(x["k"], x["s"]) for x in got] == [("a", None)]


def test_report_has_every_month(spark):
    r = spark.createDataFrame([("a", T0), ("b", T0 + timedelta(days=1)), ("b", T0 + timedelta(days=2))], "k string, at timestamp_ntz")
    t = spark.createDataFrame([("a", T0)], "k string, at timestamp_ntz")
    rep = references.orphan_report({"t": (r, references.orphans(r, t, ["k"], settle))}, {"t": "k"}).orderBy("load_month").collect()
    assert [(x["load_month"], x["n_references"], x["orphan_keys"], x["orphan_rows"]) for x in rep] == [("2026-01", 1, 0, 0), ("2026-02", 2, 1, 2)]
