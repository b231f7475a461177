"""Problem 8: mixing sources to target weights.

Method: pivotal dependent rounding. Every document of a source gets the same expected number
of copies, so that the source's expected size is its target (at most max_repeats). The whole
part is given; for the rest, documents meet in pairs and move size between their copy
probabilities, at random but keeping both expectations and the pair's total size, until one
is integral. Each task keeps one unsettled document per source; these residuals meet in a
reduction tree, so a source's final size differs from its target by one document at most.
Documents meet in order of falling size, so that the one left open at the end is a small one.
A document that stays open draws anew at each level: a draw it has survived tells something about it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN_IN = 32  # residuals of a source that one node of the tree settles
SMALL_TARGETS = 10_000  # sources up to which the rates are broadcast (a row each)


def source_name(c: Column | str) -> Column:
    """The form in which source names are the same: lower case, trimmed, one _ between words; null where blank."""
    from vdjloom.functions.text import strip

    s = F.regexp_replace(F.lower(strip(c)), r"[\s_\-‐-―]+", "_")
    s = F.trim(s, F.lit("_"))
    return F.when(s != "", s)


def move(p_a: float, w_a: float, p_b: float, w_b: float, u: float) -> tuple[float, float]:
    """One pivotal step: keeps p_a w_a + p_b w_b and both expectations; one p becomes 0 or 1."""
    up = min((1 - p_a) * w_a, p_b * w_b)
    down = min(p_a * w_a, (1 - p_b) * w_b)
    if u * (up + down) < down:
        p_a, p_b = p_a + up / w_a, p_b - up / w_b
    else:
        p_a, p_b = p_a - down / w_a, p_b + down / w_b
    near = lambda p: 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p
    return near(p_a), near(p_b)


def _settle(rows: Iterator[tuple]) -> Iterator[tuple]:
    """rows: (source, doc_id, tokens, copies, p, u). Gives every row back with p = 0 or 1 added
    to its copies, but for one row of each source that stays open (0 < p < 1). A row's u is used once, when it comes."""
    held: dict = {}
    for s, d, w, c, p, u in rows:
        if 0 < p < 1 and w <= 0:
            p = 1.0 if u < p else 0.0  # no size to keep
        if 0 < p < 1:
            if s not in held:
                held[s] = (d, w, c, p, u)
                continue
            d2, w2, c2, p2, u2 = held.pop(s)
            p, p2 = move(p, w, p2, w2, u)
            for x in ((d, w, c, p, u), (d2, w2, c2, p2, u2)):
                if 0 < x[3] < 1 and s not in held:
                    held[s] = x
                else:
                    yield s, x[0], x[1], x[2] + int(x[3] >= 0.5), 0.0, x[4]
        else:
            yield s, d, w, c + int(p), 0.0, u
    for s, (d, w, c, p, u) in held.items():
        yield s, d, w, c, p, u


_COLS = ["source", "doc_id", "tokens", "copies", "p", "u"]


def _round(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    out = []
    for row in _settle(r for p in parts for r in p[_COLS].itertuples(index=False, name=None)):
        out.append(row)
        if len(out) >= 50_000:
            yield pd.DataFrame(out, columns=_COLS)
            out = []
    if out:
        yield pd.DataFrame(out, columns=_COLS)


def _round_nodes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """As _round(), for each source and node of the tree by itself; a node's rows come together, FAN_IN for each source at most."""

    def nodes() -> Iterator[tuple]:
        key, held = None, []
        for p in parts:
            for *row, node in p[[*_COLS, "node"]].itertuples(index=False, name=None):
                if (row[0], node) != key:
                    if held:
                        yield from ((*x, key[1]) for x in _settle(iter(held)))
                    key, held = (row[0], node), []
                held.append(tuple(row))
        if held:
            yield from ((*x, key[1]) for x in _settle(iter(held)))

    out = []
    for row in nodes():
        out.append(row)
        if len(out) >= 50_000:
            yield pd.DataFrame(out, columns=[*_COLS, "node"])
            out = []
    if out:
        yield pd.DataFrame(out, columns=[*_COLS, "node"])


def shares(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """What each source can give: (source as written, source_key, target_share, max_repeats,
    available_tokens, n_docs, wanted_tokens, capacity_tokens, can_fill, rate). The mix is as
    large as all documents together; a source that cannot fill its share gives all it may."""
    have = sizes.groupBy("source_key").agg(F.sum("n_tokens").alias("available_tokens"), F.count(F.lit(1)).alias("n_docs"))
    size = sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).scalar()
    t = targets.select("source", source_name("source").alias("_k"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats"))
    t = t.filter("_k is not null and target_share is not null")
    x = t.join(have, F.col("_k") == F.col("source_key"), "left").select(
        "source", F.col("_k").alias("source_key"), "target_share", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"),
        F.coalesce("available_tokens", F.lit(0)).cast("bigint").alias("available_tokens"), F.coalesce("n_docs", F.lit(0)).cast("bigint").alias("n_docs"),
        size.cast("double").alias("_size"),
    )
    x = x.withColumn("wanted_tokens", F.col("target_share") * F.col("_size")).withColumn("capacity_tokens", F.col("available_tokens") * F.col("max_repeats"))
    rate = F.when(F.col("available_tokens") > 0, F.least(F.col("max_repeats").cast("double"), F.col("wanted_tokens") / F.col("available_tokens"))).otherwise(F.lit(0.0))
    return x.withColumn("can_fill", F.col("capacity_tokens") >= F.col("wanted_tokens")).withColumn("rate", rate).drop("_size")


def mix(sizes: DataFrame, targets: DataFrame, settle, seed: int = 11) -> DataFrame:
    """(source_key, doc_id, tokens, copies): how often each document of a targeted source enters the mix.

    sizes: (doc_id, source_key, n_tokens), written already; documents whose source has no
    target are left out. settle: writes a table and reads it back. The result is the same on
    every run: chance comes from a hash of doc_id and seed. Documents without tokens are
    rounded one by one. Null doc_ids are kept as documents; rows of one doc_id share their draws. No source is taken more often than
    max_repeats. A hot source is no hot task: tasks hold any documents, and every task sends on
    one open document per source.
    """
    rates = shares(sizes, targets).select("source_key", "rate").distinct()
    few = targets.limit(SMALL_TARGETS + 1).count() <= SMALL_TARGETS  # the size check of the broadcast
    docs = sizes.filter("source_key is not null").join(F.broadcast(rates) if few else rates, "source_key")
    kind = sizes.schema["doc_id"].dataType.simpleString()

    def draw(level: int) -> Column:
        """A number from 0 to 1 for each document, another at each level."""
        return (F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(seed), F.lit(level)), 11) / F.lit(float(1 << 53))).alias("u")

    rows = docs.select(F.col("source_key").alias("source"), "doc_id", F.col("n_tokens").alias("tokens"), F.floor("rate").cast("int").alias("copies"), (F.col("rate") - F.floor("rate")).alias("p"), draw(0))
    schema = f"source string, doc_id {kind}, tokens bigint, copies int, p double, u double"
    level = settle(rows.sortWithinPartitions(F.desc("tokens"), "doc_id").mapInPandas(_round, schema).withColumn("node", F.spark_partition_id()))
    done, nodes = level.filter("p = 0").select(*_COLS), max(1, level.agg(F.max("node")).first()[0] or 0) + 1
    open_ = level.filter("p > 0")

    depth = 0
    while nodes > 1:
        nodes, depth = -(-nodes // FAN_IN), depth + 1
        step = open_.withColumn("u", draw(depth)).withColumn("node", (F.col("node") / FAN_IN).cast("int"))
        step = step.repartition("source", "node").sortWithinPartitions("source", "node", F.desc("tokens"), "u").mapInPandas(_round_nodes, schema + ", node int")
        step = settle(step)
        done, open_ = done.unionByName(step.filter("p = 0").select(*_COLS)), step.filter("p > 0")
    last = open_.withColumn("u", draw(depth + 1)).select("source", "doc_id", "tokens", (F.col("copies") + (F.col("u") < F.col("p")).cast("int")).alias("copies"), F.lit(0.0).alias("p"), "u")
    return done.unionByName(last).select(F.col("source").alias("source_key"), "doc_id", "tokens", "copies")


def report(sizes: DataFrame, targets: DataFrame, mixed: DataFrame) -> DataFrame:
    """shares() with what was reached: mixed_tokens, most_copies, least_copies and actual_share of the mix, and exhausted:
    every document of the source was taken max_repeats times (or it has none)."""
    got = mixed.groupBy("source_key").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies"), F.min("copies").alias("least_copies"))
    whole = mixed.agg(F.sum(F.col("tokens") * F.col("copies"))).scalar()
    out = shares(sizes, targets).join(got.withColumnRenamed("source_key", "_g"), F.col("source_key") == F.col("_g"), "left").drop("_g")
    m = F.coalesce("mixed_tokens", F.lit(0)).cast("bigint")
    out = out.withColumn("exhausted", F.coalesce(F.col("least_copies") >= F.col("max_repeats"), F.lit(True)))
    return out.withColumn("mixed_tokens", m).withColumn("actual_share", F.when(whole > 0, m.cast("double") / whole.cast("double")))
