import random
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vdjloom.llm import bitmaps, frequent, top_n
from vdjloom.plans.durable import settle

quick = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


# --- problem 1 -------------------------------------------------------------------------------


def top(spark, rows, k, weight=True):
    df = spark.createDataFrame(rows, "v string, w bigint, value string, weight string, total string")
    got = frequent.frequent_items(df, "v", "w" if weight else None, k).orderBy("rank").collect()
    return [(r["value"], r["weight"], r["n_rows"]) for r in got], got


@quick
@given(st.lists(st.tuples(st.one_of(st.none(), st.sampled_from(["a", "b", "", "é", "zz", "引"])), st.one_of(st.none(), st.integers(0, 9))), max_size=60), st.integers(1, 5))
def test_frequent_against_counting(spark, rows, k):
    c, n = Counter(), Counter()
    for v, w in rows:
        if v is not None and w is not None:
            c[v] += w
            n[v] += 1
    want = sorted(((v, w, n[v]) for v, w in c.items()), key=lambda x: (-x[1], x[0]))[:k]
    assert top(spark, [(v, w, "x", "y", "z") for v, w in rows], k)[0] == want


def test_frequent_hot_value_and_total(spark):
    rows = [("hot", 2, "", "", "")] * 5000 + [(f"v{i % 3000}", 1, "", "", "") for i in range(9000)]
    random.Random(1).shuffle(rows)
    got, raw = top(spark, rows, 3)
    assert got == [("hot", 10000, 5000), ("v0", 3, 3), ("v1", 3, 3)]
    assert int(raw[0]["total_weight"]) == 19000 and abs(raw[0]["share"] - 10000 / 19000) < 1e-12
    assert top(spark, rows, 1, weight=False)[0] == [("hot", 5000, 5000)]


def test_frequent_merges_sorted_runs_in_a_tree(spark):
    """The sort stands below the merge, and the heaps of many ranges meet in more than one level."""
    df = spark.range(200_000).select((F.col("id") % 5003).cast("string").alias("v"), (F.col("id") % 7).alias("w"))
    f = frequent.frequent_items(df, "v", "w", 20, ranges=70)
    plan = f._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 4  # runs, merge, and two levels: 70 ranges to 3 to 1
    assert "Sort [value" in plan.split("MapInArrow")[-2]
    want = df.groupBy("v").agg(F.sum("w").alias("w")).orderBy(F.desc("w"), "v").limit(20)
    assert [(r["value"], r["weight"]) for r in f.orderBy("rank").collect()] == [tuple(r) for r in want.collect()]


def test_frequent_empty_and_long(spark):
    assert top(spark, [], 3)[0] == []
    assert top(spark, [(None, 1, "", "", "")], 3)[0] == []
    long = "x" * 100_000
    assert top(spark, [(long, 1, "", "", ""), (long, 2, "", "", "")], 3)[0] == [(long, 3, 2)]
    with pytest.raises(ValueError):
        top(spark, [], 0)


# --- problem 2 -------------------------------------------------------------------------------


def best(spark, rows, n):
    df = spark.createDataFrame(rows, "g string, i string, s bigint, group_key string, score string")
    got = top_n.top_n(df, "g", "i", "s", n).collect()
    out = defaultdict(list)
    for r in sorted(got, key=lambda r: (str(r["group_key"]), r["rank"])):
        out[r["group_key"]].append((r["item_key"], int(r["score"])))
    return dict(out)


def brute_best(rows, n):
    total = defaultdict(Counter)
    for g, i, s in rows:
        if s is not None:
            total[g][i] += s
    return {g: sorted(c.items(), key=lambda x: (-x[1], x[0] is not None, x[0] or ""))[:n] for g, c in total.items() if c}


@quick
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.sampled_from(["x", "y", "z", "é", "", None]), st.one_of(st.none(), st.integers(-3, 3))), max_size=50), st.integers(1, 4))
def test_top_n_against_sorting(spark, rows, n):
    assert best(spark, [(*r, "k", "s") for r in rows], n) == brute_best(rows, n)


def test_top_n_hot_group(spark):
    rng = random.Random(2)
    rows = [("hot", f"i{rng.randrange(4000)}", rng.randrange(5)) for _ in range(12000)] + [(f"g{i % 800}", f"i{i}", i % 3) for i in range(3000)]
    assert best(spark, [(*r, "k", "s") for r in rows], 10) == brute_best(rows, 10)


@given(st.lists(st.lists(st.integers(0, 20)), max_size=9))
def test_loser_tree_merges(runs):
    tree, out = top_n.LoserTree([sorted(r) for r in runs] or [[]]), []
    while (x := tree.pop()) is not None:
        out.append(x)
    assert out == sorted(x for r in runs for x in r)


# --- problem 5 -------------------------------------------------------------------------------


def test_sizing():
    assert bitmaps.bits_for(1000, 0.02) == bitmaps.LEAST_BITS
    m = bitmaps.bits_for(5e6, 0.01)
    assert bitmaps.standard_error(5e6, m) <= 0.01 and m * 8 >= 5e6
    with pytest.raises(ValueError):
        bitmaps.bits_for(10, 0)


def test_estimates_lie_within_their_error(spark):
    rows = [("a", i % 20_000) for i in range(40_000)] + [("b", i) for i in range(500)] + [("c", 1)] * 50
    df = spark.createDataFrame(rows, "g string, v bigint").withColumn("v", F.col("v").cast("string"))
    for m in (32_768, 131_072):
        e = {r["g"]: r for r in bitmaps.estimate(bitmaps.sketch(df, ["g"], "v", m), ["g"], m).collect()}
        for g, n in (("a", 20_000), ("b", 500), ("c", 1)):
            assert abs(e[g]["estimate"] - n) <= max(1.0, 4 * e[g]["std_error"] * n)
            assert e[g]["set_bits"] <= n
        assert e["a"]["n_rows"] == 40_000


def test_parts_merge_to_the_same_bitmap(spark):
    df = spark.createDataFrame([(str(i % 7), str(i % 900)) for i in range(3000)], "d string, v string")
    whole = bitmaps.estimate(bitmaps.sketch(df.withColumn("k", F.lit(1)), ["k"], "v"), ["k"], bitmaps.LEAST_BITS).first()["set_bits"]
    parts = bitmaps.merge(bitmaps.sketch(df, ["d"], "v"), [])
    assert bitmaps.estimate(parts, [], bitmaps.LEAST_BITS).first()["set_bits"] == whole


def test_every_combination(spark):
    df = spark.createDataFrame([("x", "p", "1"), ("x", None, "2"), ("y", "p", "1"), ("y", "p", None)], "a string, b string, v string")
    got = {(r["grouping"], r["a"], r["b"]): round(r["estimate"]) for r in bitmaps.distinct_counts(df, ["a", "b"], "v").collect()}
    assert got == {("a,b", "x", "p"): 1, ("a,b", "x", None): 1, ("a,b", "y", "p"): 1, ("a", "x", None): 2, ("a", "y", None): 1, ("b", None, "p"): 1, ("b", None, None): 1, ("", None, None): 2}


def test_more_than_a_million_values(spark):
    df = spark.range(2_000_000).select(F.lit("x").alias("g"), F.col("id").cast("string").alias("v"))
    for r in bitmaps.distinct_counts(df, ["g"], "v").collect():
        assert r["std_error"] <= 0.02 and abs(r["estimate"] - 2_000_000) <= 4 * r["std_error"] * 2_000_000


def test_five_million_values(spark):
    df = spark.range(5_000_000).select(F.lit("x").alias("g"), F.col("id").cast("string").alias("v"))
    r = bitmaps.distinct_counts(df, ["g"], "v").first()
    assert r["std_error"] <= 0.02 and abs(r["estimate"] - 5_000_000) <= 4 * r["std_error"] * 5_000_000


def test_small_sets_are_few_words(spark):
    df = spark.range(3000).select(F.col("id").alias("g"), F.col("id").cast("string").alias("v"))
    assert bitmaps.sketch(df, ["g"], "v", 1 << 22).count() == 3000


def test_repeating_sets_of_all_sizes(spark):
    """Sets far from the border are decided by their estimate, those at it exactly, and so are sets whose bitmap is full."""
    n = F.expr("case when id < 100000 then 'far_in' when id < 200000 then 'far_out' when id < 300000 then 'just_in' when id < 400000 then 'just_out' else 'full' end")
    v = F.expr("case when id < 100000 then id % 10000 when id < 200000 then id when id < 300000 then id % 39999 when id < 400000 then id % 40000 else id % 900000 end")
    df = spark.range(3_000_000).select(n.alias("g"), v.cast("string").alias("v"))
    for settle_, n_max in ((None, None), (None, 1000.0), (settle, None)):
        got = {r["g"] for r in bitmaps.strongly_repeating(df, ["g"], "v", n_max=n_max, settle=settle_).collect()}
        assert got == {"far_in", "just_in", "full"}


def test_outside_counts_bad_estimates(spark):
    df = spark.range(40_000).select((F.col("id") % 2).cast("string").alias("g"), F.col("id").cast("string").alias("v"))
    e = bitmaps.distinct_counts(df, ["g"], "v")
    assert sorted(map(tuple, bitmaps.outside(df, ["g"], "v", e).collect())) == [("", 1, 40_000, 0), ("g", 2, 40_000, 0)]
    bad = e.withColumn("estimate", F.col("estimate") * 2)
    assert sorted(map(tuple, bitmaps.outside(df, ["g"], "v", bad).collect())) == [("", 1, 40_000, 1), ("g", 2, 40_000, 2)]


def test_full_bitmaps_have_no_estimate(spark):
    df = spark.range(600_000).select(F.when(F.col("id") < 9, "few").otherwise("many").alias("g"), F.col("id").cast("string").alias("v"))
    e = {r["g"]: r for r in bitmaps.estimate(bitmaps.sketch(df, ["g"], "v"), ["g"], bitmaps.LEAST_BITS).collect()}
    assert e["many"]["set_bits"] == bitmaps.LEAST_BITS and e["many"]["estimate"] is None and e["many"]["std_error"] is None
    assert round(e["few"]["estimate"]) == 9


@quick
@given(st.lists(st.tuples(st.sampled_from(["a", None]), st.integers(0, 12)), max_size=80))
def test_repeating_sets_are_exact(spark, rows):
    by = defaultdict(list)
    for g, v in rows:
        by[g].append(v)
    want = {g for g, vs in by.items() if len(vs) >= 5 and 5 * len(set(vs)) < 2 * len(vs)}
    df = spark.createDataFrame([(g, str(v), "x") for g, v in rows], "g string, v string, n_rows string")
    assert {r["g"] for r in bitmaps.strongly_repeating(df, ["g"], "v", least_rows=5).collect()} == want
