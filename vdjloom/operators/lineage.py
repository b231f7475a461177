"""Lineage: uniqueness-guarded joins, reason ladders and observation counters (J01-J05, J07, J10,
F34, F35, A12-A17, A28)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vdjloom.functions.calls import calls
from vdjloom.functions.text import pct
from vdjloom.operators.filters import retained_subsets


def unique_join(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], order: str, values: list[str], count: str = "n_matches") -> DataFrame:
    """Left with `count` (right rows of its key) and the right values of the first such row by
    `order`, which are null unless the key occurs exactly once on the right. left keeps its rows.
    The right side is one row per key before the join."""
    first = F.min_by(F.struct(*(F.col(v).alias(v) for v in values)), F.col(order))
    r = right.groupBy(*(F.col(k).alias(f"_r{i}") for i, k in enumerate(right_keys))).agg(F.count(F.lit(1)).alias(count), first.alias("_v"))
    same = F.lit(True)
    for i, k in enumerate(left_keys):
        same = same & (F.col(k) == F.col(f"_r{i}"))
    j = left.join(r, same, "left")
    n = F.coalesce(F.col(count), F.lit(0))
    return j.select(*left.columns, n.alias(count), *(F.when(n == 1, F.col(f"_v.{v}")).alias(v) for v in values))


def mapping_reason(own: Column, matches: Column, reason: Column) -> Column:
    """own occurrences of the key other than 1: ambiguous_lineage; no annotation: missing_airr_row;
    several: duplicate_airr_rows; else the annotation's reason."""
    return F.when(own != 1, "ambiguous_lineage").when(matches == 0, "missing_airr_row").when(matches > 1, "duplicate_airr_rows").otherwise(reason)


def mapping_lineage(queries: DataFrame, annotations: DataFrame, key: list[str], order: str, values: list[str]) -> DataFrame:
    """J01 with F34: queries with their annotation's values and filter_reason by the guarded join."""
    own = queries.groupBy(*(F.col(k).alias(f"__{k}") for k in key)).agg(F.count(F.lit(1)).alias("n_queries"))
    same = F.lit(True)
    for k in key:
        same = same & (F.col(k) == F.col(f"__{k}"))
    q = queries.join(own, same, "left").drop(*(f"__{k}" for k in key))
    j = unique_join(q, annotations, key, key, order, [*values, "filter_reason"])
    sure = (F.col("n_queries") == 1) & (F.col("n_matches") == 1)
    reason = mapping_reason(F.coalesce("n_queries", F.lit(0)), F.col("n_matches"), F.col("filter_reason"))
    return j.withColumn("filter_reason", reason).withColumns({v: F.when(sure, F.col(v)) for v in values})


def raw_reason(n: dict[str, Column], recorded: dict[str, Column], queries: Column, annotated: Column, reason: Column) -> Column:
    """the first rule that holds. n: reads with this id for raw, raw_other, fastp, fastp_other, clean,
    clean_other; recorded: whether the fastp, fastp_other, clean, clean_other files are known."""
    several = F.greatest(*n.values()) > 1
    both = lambda s: recorded[s] & recorded[f"{s}_other"]
    return (
        F.when((n["raw"] != 1) | several | (queries > 1), "ambiguous_lineage")
        .when(n["raw_other"] != 1, "pair_identity_unverified")
        .when(both("fastp") & (n["fastp"] != n["fastp_other"]), "pair_identity_unverified")
        .when(both("clean") & (n["clean"] != n["clean_other"]), "pair_identity_unverified")
        .when((n["fastp"] == 0) & recorded["fastp"], "not_seen_after_fastp").when(n["fastp"] == 0, "fastp_membership_unavailable")
        .when(n["clean"] == 0, "clean_membership_unavailable").when(queries == 0, "not_merged").when(annotated == 0, "missing_airr_row")
        .when(annotated > 1, "duplicate_airr_rows").otherwise(reason)
    )


def raw_lineage(reads: DataFrame, queries: DataFrame, annotations: DataFrame, mate: str = "R1") -> DataFrame:
    """Each raw read of the mate with the reason why it did or did not end in a kept row.

    reads: (stage, canonical), stages raw_R1 ... clean_R2; queries: (canonical, sequence_id);
    annotations: (sequence_id, filter_reason). All counts of an id are one aggregate, which stands for its raw reads, too:
    an id is one row until the end. A stage is recorded when the reads have any row of it (one row, within the plan).
    """
    other = "R2" if mate == "R1" else "R1"
    names = {"raw": f"raw_{mate}", "raw_other": f"raw_{other}", "fastp": f"fastp_{mate}", "fastp_other": f"fastp_{other}", "clean": f"clean_{mate}", "clean_other": f"clean_{other}"}
    per = reads.groupBy("canonical").agg(*(F.sum(F.when(F.col("stage") == s, 1).otherwise(0)).alias(k) for k, s in names.items()))
    stages = ("fastp", "fastp_other", "clean", "clean_other")
    known = reads.agg(F.struct(*(F.coalesce(F.max(F.col("stage") == names[s]), F.lit(False)).alias(s) for s in stages))).scalar()
    q = queries.groupBy(F.col("canonical").alias("_qc")).agg(F.count(F.lit(1)).alias("_q"), F.min("sequence_id").alias("_sid"))
    a = annotations.groupBy(F.col("sequence_id").alias("_as")).agg(F.count(F.lit(1)).alias("_a"), F.min("filter_reason").alias("_reason"))
    j = per.filter("raw > 0").withColumn("_known", known).join(q, F.col("canonical") == F.col("_qc"), "left").join(a, F.col("_sid") == F.col("_as"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    r = raw_reason({k: F.col(k) for k in names}, {s: F.col(f"_known.{s}") for s in stages}, zero("_q"), zero("_a"), F.col("_reason"))
    return j.select("canonical", r.alias("filter_reason"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("raw"))).alias("_time")).drop("_time")


def matching_totals(obs: DataFrame) -> DataFrame:
    """Shared inputs counted once: the rows of one (sample_key, matching_source, matching_ordinal) are one
    input; its scope and class are theirs if they agree, else mixed_annotation_evidence and
    conflicting_assessment; chains lists theirs."""
    same = lambda c, other: F.when(F.min(c).eqNullSafe(F.max(c)), F.min(c)).otherwise(other)
    u = obs.groupBy("sample_key", "matching_source", "matching_ordinal").agg(
        same("scope", "mixed_annotation_evidence").alias("scope"), same("sample_match_class", "conflicting_assessment").alias("match_class"),
        F.min("matching_unit").alias("unit"), F.array_join(F.array_sort(F.collect_set("chain")), ",").alias("chains"),
    )
    return u.groupBy("sample_key", "scope", "unit", "chains", "match_class").agg(F.count(F.lit(1)).alias("count"))


def counters(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Match class, filter reason and trim state counts in one pass: (*keys, counter, value, count)."""
    trim = F.coalesce(F.nullif(F.col("trim_state"), F.lit("")), F.lit("not_recorded"))
    long = obs.select(*keys, F.explode(F.array(
        F.struct(F.lit("match_class").alias("counter"), F.col("match_class").alias("value")),
        F.struct(F.lit("filter_reason").alias("counter"), F.col("filter_reason").alias("value")),
        F.struct(F.lit("trim_state").alias("counter"), trim.alias("value")),
    )).alias("_c")).select(*keys, "_c.*")
    return long.groupBy(*keys, "counter", "value").agg(F.count(F.lit(1)).alias("count"))


def densify(counts: DataFrame, keys: list[str], column: str, values: list[str], count: str = "count") -> DataFrame:
    """A row for each key and value, 0 where none is counted."""
    dense = counts.select(*keys).distinct().select("*", F.explode(F.array(*(F.lit(v) for v in values))).alias(column))
    full = dense.unionByName(counts.select(*keys, column)).distinct()
    k = [*keys, column]
    c = counts.select(*(F.col(x).alias(f"__{x}") for x in k), count)
    same = F.lit(True)
    for x in k:
        same = same & F.col(x).eqNullSafe(F.col(f"__{x}"))
    return full.join(c, same, "left").select(*k, F.coalesce(count, F.lit(0)).alias(count))


def gene_observations(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Per key, subset (all, retained), segment and gene label the rows and their percent, and the
    genes' coverage. A row with one gene has its name as label, with several [Multiple], with none [None]."""
    rows = retained_subsets(obs)
    seg = rows.select(*keys, "subset", F.explode(F.array(*(F.struct(F.lit(s).alias("segment"), calls(f"{s.lower()}_call").alias("genes")) for s in "VJC"))).alias("_s")).select(*keys, "subset", "_s.*")
    label = F.when(F.size("genes") == 1, F.element_at("genes", 1)).when(F.size("genes") > 1, "[Multiple]").otherwise("[None]")
    c = seg.groupBy(*keys, "subset", "segment", label.alias("gene")).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy(*keys, "subset", "segment"))
    return c.withColumn("denominator", total).withColumn("percent", pct(F.col("count"), total))


def gene_coverage(obs: DataFrame, keys: list[str], reference: DataFrame | None = None) -> DataFrame:
    """Per key, subset, segment and gene the rows in which it is the only candidate, and those in which it
    is one of several. reference: (*keys, segment, gene) adds its unseen genes as zero_observed."""
    rows = retained_subsets(obs)
    seg = rows.select(*keys, "subset", F.explode(F.array(*(F.struct(F.lit(s).alias("segment"), calls(f"{s.lower()}_call").alias("genes")) for s in "VJC"))).alias("_s")).select(*keys, "subset", "_s.*")
    g = seg.select(*keys, "subset", "segment", (F.size("genes") == 1).alias("one"), F.explode("genes").alias("gene"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    out = g.groupBy(*keys, "subset", "segment", "gene").agg(n(F.col("one")).alias("unique_count"), n(~F.col("one")).alias("ambiguous_count"))
    if reference is not None:
        zero = reference.select(*keys, "segment", "gene").distinct().withColumn("subset", F.explode(F.array(F.lit("all"), F.lit("retained"))))
        zero = zero.join(out.select(*keys, "subset", "segment", "gene"), [*keys, "subset", "segment", "gene"], "left_anti")
        out = out.unionByName(zero.withColumn("unique_count", F.lit(0).cast("bigint")).withColumn("ambiguous_count", F.lit(0).cast("bigint")))
    return out.withColumn("status", F.when(F.col("unique_count") + F.col("ambiguous_count") > 0, "observed").otherwise("zero_observed"))


def mixed_evidence(obs: DataFrame) -> DataFrame:
    """Sample and chain pairs whose rows have more than one scope; they must not be reported together."""
    return obs.groupBy("sample_key", "chain").agg(F.min("scope").alias("a"), F.max("scope").alias("b")).filter("a <> b").select("sample_key", "chain")


def observation_filter(obs: DataFrame, *, primer: str | None = None, gene: str | None = None, segment: str = "V", trim: str | None = None, reasons: list[str] | None = None) -> DataFrame:
    """Rows that have a primer, a gene among their candidates, a trim state, or one of the reasons.
    primers may be an array or its JSON text."""
    out = obs
    if primer is not None:
        p = F.from_json("primers", "array<string>") if dict(obs.dtypes)["primers"] == "string" else F.col("primers")
        out = out.filter(F.array_contains(p, primer))
    if gene is not None:
        out = out.filter(F.array_contains(calls(f"{segment.lower()}_call"), gene))
    if trim is not None:
        out = out.filter(F.col("trim_state") == trim)
    return out.filter(F.col("filter_reason").isin(*reasons)) if reasons else out
