import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vdjloom.llm import mixing, packing, tokens
from vdjloom.plans.durable import settle

quick = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


# --- problem 7 -------------------------------------------------------------------------------


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=6), st.integers(0, 40))
def test_fill_is_the_best_subset(counts, room):
    sums = {0}
    for k, n in counts.items():
        sums = {s + k * c for s in sums for c in range(n + 1)}
    got = packing.fill(counts, room)
    assert all(0 < c <= counts[k] for k, c in got.items())
    assert sum(k * c for k, c in got.items()) == max(s for s in sums if s <= room)


@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), max_size=12))
def test_plan_uses_every_item_once(counts):
    used = {}
    for one, times in packing.plan(counts, 50):
        assert sum(k * c for k, c in one.items()) <= 50
        for k, c in one.items():
            used[k] = used.get(k, 0) + c * times
    assert used == counts


def check_pack(spark, sizes, capacity, window=packing.WINDOW_ITEMS):
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)], "doc_id bigint, n_tokens bigint, container string")
    rows = packing.pack(df, capacity=capacity, window=window).collect()
    held, seen = {}, {}
    for r in rows:
        seen.setdefault(r["doc_id"], []).append(r)
        if r["container"] is not None:
            held.setdefault(r["container"], []).append((r["container_offset"], r["tokens"]))
    for spans in held.values():
        at = 0
        for o, t in sorted(spans):
            assert o == at
            at += t
        assert at <= capacity
    for i, n in enumerate(sizes):
        pieces = sorted(seen[i], key=lambda r: r["piece"])
        assert len(pieces) == pieces[0]["n_pieces"] == max(1, -(-(n or 0) // capacity))
        assert sum(p["tokens"] for p in pieces) == (n or 0)
        assert [p["first_token"] for p in pieces] == [k * capacity for k in range(len(pieces))]
        assert (pieces[0]["container"] is None) == (not n)
    return held


@quick
@given(st.lists(st.one_of(st.none(), st.integers(0, 130)), max_size=40))
def test_pack(spark, sizes):
    check_pack(spark, sizes, 50)


def test_pack_is_nearly_full(spark):
    rng = random.Random(3)
    sizes = [rng.randrange(1, 900) for _ in range(6000)]
    held = check_pack(spark, sizes, 2048)
    assert sum(sizes) / (len(held) * 2048) > 0.99
    check_pack(spark, sizes[:500], 2048, window=64)


def test_fill_does_not_hang_on_partitions(spark):
    rng = random.Random(5)
    sizes = [rng.randrange(1, 900) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, n_tokens bigint")
    least = -(-sum(sizes) // packing.CAPACITY)
    for tasks in (None, 60):
        have = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", "60")
        try:
            rows = packing.pack(df, tasks=tasks).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", have)
        held = {}
        for r in rows:
            held[r["container"]] = held.get(r["container"], 0) + r["tokens"]
        assert sorted(r["doc_id"] for r in rows) == list(range(2000)) and max(held.values()) <= packing.CAPACITY
        assert len(held) <= least * 1.01 + 2 if tasks is None else len(held) <= least * 1.05


def test_cut_texts_lie_in_several_containers(spark):
    df = spark.createDataFrame([(1, 2048), (2, 2049), (3, 4096), (4, None), (5, 1), (6, 9000)], "doc_id bigint, n_tokens bigint")
    assert sorted(r[0] for r in packing.in_several(packing.pack(df)).collect()) == [2, 3, 6]


def test_tokens_cut_and_joined_again():
    e = tokens.encoder()
    text = "Größe 引物 cells are small. " * 900
    t = e.encode_ordinary(text)
    pieces = [t[i : i + packing.CAPACITY] for i in range(0, len(t), packing.CAPACITY)]
    assert len(pieces) > 1 and e.decode([x for p in pieces for x in p]) == text


def test_token_counts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (4, "<|endoftext|>"), (5, "x" * 50_000)], "doc_id bigint, text string")
    n = {r["doc_id"]: r["n_tokens"] for r in tokens.with_tokens(df).collect()}
    assert n[1] == n[2] == 0 and n[3] == 2 and n[4] > 1 and n[5] > 100


# --- problem 8 -------------------------------------------------------------------------------


def sizes_of(spark, rows):
    return settle(spark.createDataFrame(rows, "doc_id bigint, source_key string, n_tokens bigint"))


def targets_of(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_names(spark):
    df = spark.createDataFrame([(x,) for x in ("Run Notes", " run-notes\t", "RUN_NOTES", "run__notes", "", " ", None)], "s string")
    assert [r[0] for r in df.select(mixing.source_name("s")).collect()] == ["run_notes"] * 4 + [None] * 3


@given(st.floats(0.01, 0.99), st.integers(1, 999), st.floats(0.01, 0.99), st.integers(1, 999), st.floats(0, 1))
def test_move_keeps_size(p, w, q, v, u):
    a, b = mixing.move(p, w, q, v, u)
    assert 0 <= a <= 1 and 0 <= b <= 1 and (a in (0, 1) or b in (0, 1))
    assert abs(a * w + b * v - p * w - q * v) < 1e-4


def test_shares_are_reached(spark):
    rng = random.Random(4)
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 4}", rng.randrange(1, 400)) for i in range(4000)] + [(9001, "none", 50), (9002, None, 70), (9003, "s0", 0), (9004, "s0", None)]
    sizes = sizes_of(spark, rows).repartition(40)
    t = targets_of(spark, [("hot", 0.2, 1), ("S0", 0.5, 4), ("s1", 0.25, 1), ("absent", 0.05, 3)])
    sizes = settle(sizes)
    got = mixing.mix(sizes, t, settle)
    rep = {r["source"]: r for r in mixing.report(sizes, t, got).collect()}
    for r in rep.values():
        want = min(r["wanted_tokens"], r["capacity_tokens"])
        assert abs(r["mixed_tokens"] - want) <= 400, r
        assert (r["most_copies"] or 0) <= r["max_repeats"]
    assert {s for s, r in rep.items() if r["exhausted"] and r["mixed_tokens"] < r["wanted_tokens"]} == {s for s, r in rep.items() if not r["can_fill"]}
    assert rep["absent"]["can_fill"] is False and rep["absent"]["mixed_tokens"] == 0
    assert abs(sum(r["actual_share"] for r in rep.values()) - 1) < 1e-9
    again = sorted(map(tuple, mixing.mix(sizes, t, settle).collect()), key=str)
    assert again == sorted(map(tuple, got.collect()), key=str)
    n = {"hot": 0, "s0": 0, "s1": 0}
    for _, s, _ in rows:
        if s in n:
            n[s] += 1
    assert got.groupBy("source_key").count().rdd.collectAsMap() == n


def test_mix_of_nothing(spark):
    sizes = sizes_of(spark, [])
    t = targets_of(spark, [("a", 1.0, 2)])
    assert mixing.mix(sizes, t, settle).count() == 0
    r = mixing.report(sizes, t, mixing.mix(sizes, t, settle)).first()
    assert r["mixed_tokens"] == 0 and r["actual_share"] is None


def test_each_document_keeps_its_expectation(spark):
    """Many sources alike stand for many seeds: the mean copies of the document at each place, and their joint size."""
    n, places, share = 9_000, 20, 0.3
    rows = spark.range(n * places).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.floor(F.col("id") / places)).alias("source_key"), (F.lit(10) + (F.col("id") % places) * 3).alias("n_tokens"), (F.col("id") % places).alias("place")
    )
    sizes = settle(rows.repartition(3))
    total = sum(10 + 3 * i for i in range(places))
    targets = spark.range(n).select(F.concat(F.lit("s"), "id").alias("source"), F.lit(share / n).alias("target_share"), F.lit(1).alias("max_repeats"))
    got = settle(mixing.mix(sizes.drop("place"), targets, settle)).join(sizes.select("doc_id", "place"), "doc_id")
    error = (share * (1 - share) / n) ** 0.5
    for r in got.groupBy("place").agg(F.avg("copies").alias("m")).collect():
        assert abs(r["m"] - share) < 3.3 * error, r
    off = got.groupBy("source_key").agg(F.abs(F.sum(F.col("copies") * F.col("tokens")) - share * total).alias("d")).agg(F.max("d")).first()[0]
    assert off <= 10 + 3 * places


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_expectation_is_kept(seed):
    rng = random.Random(seed)
    hits = [0.0, 0.0]
    for _ in range(4000):
        a, b = mixing.move(0.3, 5, 0.6, 2, rng.random())
        hits[0] += a
        hits[1] += b
    assert abs(hits[0] / 4000 - 0.3) < 0.03 and abs(hits[1] / 4000 - 0.6) < 0.03


def test_clashing_columns(spark):
    df = spark.createDataFrame([("x", 5, "y")], "doc_id string, n_tokens bigint, piece string").withColumn("tokens", F.lit(1))
    assert packing.pack(df).first()["tokens"] == 5
