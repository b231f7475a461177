"""Gene usage, its unique-CDR3 form, and exact copy allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vdjloom.functions.text import pct

_KEY = ["group_id", "primer", "segment"]


def _join_on(keys: list[str], prefix: str = "__") -> Column:
    c = F.lit(True)
    for k in keys:
        c = c & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return c


def _as(df: DataFrame, keys: list[str], prefix: str = "__") -> DataFrame:
    return df.select(*(F.col(k).alias(f"{prefix}{k}") for k in keys), *(c for c in df.columns if c not in keys))


def demote_duplicates(records: DataFrame, keys: list[str]) -> DataFrame:
    """Records of a key that occurs more than once become ineligible (eligible = 0)."""
    twice = records.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(F.count(F.lit(1)).alias("_n"))
    return records.join(twice, _join_on(keys), "left").withColumn("eligible", F.when(F.col("_n") > 1, 0).otherwise(F.col("eligible"))).select(*records.columns)


def _members(records: DataFrame, calls: DataFrame) -> DataFrame:
    """Eligible records with each of their calls; the sample's records have primer '', a primer's
    records its name. records: with sample_record (1: of the sample, 0: a primer's share)."""
    r = records.filter("eligible = 1").withColumn("primer", F.when(F.col("sample_record") == 1, "").otherwise(F.col("primer"))).filter("sample_record = 1 or primer <> ''")
    c = calls.select(F.col("record_id").alias("_r"), "segment", "gene", "assignment")
    return r.join(c, F.col("id") == F.col("_r"))


def usage_counts(records: DataFrame, calls: DataFrame) -> DataFrame:
    """(group_id, primer, segment, gene, assignment, count): the weight in the sample's scope
    (primer '') and in each primer's."""
    return _members(records, calls).groupBy(*_KEY, "gene", "assignment").agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("count"))


def gene_usage(counts: DataFrame, reference: DataFrame | None = None, primers: DataFrame | None = None) -> DataFrame:
    """Every gene of a group, primer and segment that is observed or (for registered
    primers) in the reference, with counts, denominator, percent and status.

    reference: (group_id, segment, gene); primers: (group_id, primer), '' being the sample's
    scope. The denominator is the uniquely assigned weight of the segment, 0 gives percent null.
    outside_reference: observed, the segment has a reference, the gene is not in it.
    """
    u = lambda a: F.coalesce(F.sum(F.when(F.col("assignment") == a, F.col("count"))), F.lit(0))
    per = counts.groupBy(*_KEY, "gene").agg(u("unique").alias("unique_count"), u("ambiguous").alias("ambiguous_count"))
    den = per.groupBy(*_KEY).agg(F.sum("unique_count").alias("denominator"))
    seen = per.filter("gene <> ''").select(*_KEY, "gene")
    if reference is None or primers is None:
        keys = seen.distinct()
        keys = keys.withColumn("reference_catalog", F.lit(0)).withColumn("_available", F.lit(0))
    else:
        ref = reference.select("group_id", "segment", "gene").distinct()
        dense = primers.select("group_id", "primer").distinct().join(ref, "group_id").select(*_KEY, "gene").withColumn("_in", F.lit(1))
        any_ = ref.select(F.col("group_id").alias("__group_id"), F.col("segment").alias("__segment")).distinct().withColumn("_available", F.lit(1))
        known = _as(ref.withColumn("reference_catalog", F.lit(1)), ["group_id", "segment", "gene"])
        keys = dense.select(*_KEY, "gene").unionByName(seen).distinct()
        keys = keys.join(any_, _join_on(["group_id", "segment"]), "left").drop("__group_id", "__segment").join(known, _join_on(["group_id", "segment", "gene"]), "left").drop("__group_id", "__segment", "__gene")
        keys = keys.withColumn("reference_catalog", F.coalesce("reference_catalog", F.lit(0)))
    k = [*_KEY, "gene"]
    x = keys.join(_as(per, k), _join_on(k), "left").drop(*(f"__{c}" for c in k)).join(_as(den, _KEY), _join_on(_KEY), "left").drop(*(f"__{c}" for c in _KEY))
    uq, am, de = F.coalesce("unique_count", F.lit(0)), F.coalesce("ambiguous_count", F.lit(0)), F.coalesce("denominator", F.lit(0))
    status = (
        F.when((F.col("reference_catalog") == 0) & (F.coalesce("_available", F.lit(0)) == 1) & (uq + am > 0), "outside_reference")
        .when(uq > 0, "observed").when(am > 0, "ambiguous_only").otherwise("zero_observed")
    )
    return x.select(*k, uq.alias("unique_count"), am.alias("ambiguous_count"), de.alias("denominator"), F.when(de > 0, pct(uq, de)).alias("percent"), "reference_catalog", status.alias("status"))


def unique_cdr3_counts(records: DataFrame, calls: DataFrame) -> DataFrame:
    """(*key, gene, assignment, count): distinct valid CDR3s per gene. Two-level: the rows of a
    value combine first, so a hot gene is spread by value."""
    m = _members(records.filter("aa_valid = 1 and aa_field = 'cdr3_aa'"), calls)
    once = m.select(*_KEY, "gene", "assignment", "aa_value").distinct()
    return once.groupBy(*_KEY, "gene", "assignment").agg(F.count("aa_value").alias("count"))


def unique_cdr3_usage(expression: DataFrame, aa_counts: DataFrame, groups_with_field: DataFrame) -> DataFrame:
    """A row per expression row of groups that have the field; the denominator is the sum of the
    genes' distinct counts (a CDR3 in two genes counts twice); status is the expression row's."""
    u = lambda a: F.coalesce(F.sum(F.when(F.col("assignment") == a, F.col("count"))), F.lit(0))
    per = aa_counts.groupBy(*_KEY, "gene").agg(u("unique").alias("_u"), u("ambiguous").alias("_a"))
    den = per.groupBy(*_KEY).agg(F.sum("_u").alias("_d"))
    k = [*_KEY, "gene"]
    e = expression.join(groups_with_field.select("group_id").distinct(), "group_id", "left_semi").select(*k, "reference_catalog", "status")
    x = e.join(_as(per, k), _join_on(k), "left").drop(*(f"__{c}" for c in k)).join(_as(den, _KEY), _join_on(_KEY), "left")
    uq, am, de = F.coalesce("_u", F.lit(0)), F.coalesce("_a", F.lit(0)), F.coalesce("_d", F.lit(0))
    return x.select(*k, uq.alias("unique_count"), am.alias("ambiguous_count"), de.alias("denominator"), F.when(de > 0, pct(uq, de)).alias("percent"), "reference_catalog", "status")


def all_usage(expression: DataFrame, unique: DataFrame) -> DataFrame:
    """Both metrics in one table."""
    a = expression.withColumn("metric", F.lit("expression")).withColumn("aa_field", F.lit(""))
    return a.unionByName(unique.withColumn("metric", F.lit("unique_cdr3")).withColumn("aa_field", F.lit("cdr3_aa")))


def rebase(usage: DataFrame) -> DataFrame:
    """Denominators and percentages again from the unique counts that are there, by segment and metric."""
    total = F.sum("unique_count").over(Window.partitionBy(*_KEY, "metric", "aa_field"))
    return usage.withColumn("denominator", total).withColumn("percent", F.when(total > 0, pct(F.col("unique_count"), total)))


def usage_filter(usage: DataFrame, *, zero_only=False, observed_only=False, reference_only=False, definite_only=False, state: str = "", name: str = "") -> DataFrame:
    """F32: the rows asked for."""
    if state and state not in ("zero_observed", "ambiguous_only", "outside_reference"):
        raise ValueError(f"unknown state: {state}")
    out = usage
    if zero_only:
        out = out.filter("status = 'zero_observed'")
    if observed_only:
        out = out.filter("unique_count > 0")
    if reference_only:
        out = out.filter("reference_catalog = 1")
    if definite_only:
        out = out.filter("unique_count > 0 or (ambiguous_count = 0 and status = 'zero_observed')")
    if state:
        out = out.filter(F.col("status") == state)
    return out.filter(F.contains(F.lower("gene"), F.lower(F.lit(name.strip())))) if name.strip() else out


def group_metadata(records: DataFrame, calls: DataFrame) -> DataFrame:
    """Per group its records, excluded ones, the records per isotype state, valid CDR3s, and per
    segment how many records are unique, ambiguous or unannotated (long form: fact, key, value)."""
    g = records.groupBy("group_id").agg(F.count(F.lit(1)).alias("records"), F.sum((F.col("eligible") != 1).cast("int")).cast("bigint").alias("excluded"), F.sum((F.col("aa_valid") == 1).cast("int")).cast("bigint").alias("valid_aa"))
    base = g.select("group_id", F.expr("stack(3, 'records', '', records, 'excluded', '', excluded, 'valid_aa', '', valid_aa) as (fact, name, value)"))
    iso = records.filter("eligible = 1").groupBy("group_id", F.col("isotype_state").alias("name")).agg(F.count(F.lit(1)).alias("value")).select("group_id", F.lit("isotype_state").alias("fact"), "name", "value")
    c = calls.select(F.col("record_id").alias("_r"), "segment", "assignment").distinct()
    seg = records.filter("eligible = 1").join(c, F.col("id") == F.col("_r")).groupBy("group_id", F.concat_ws(":", "segment", "assignment").alias("name")).agg(F.count(F.lit(1)).alias("value")).select("group_id", F.lit("assignment").alias("fact"), "name", "value")
    return base.unionByName(iso).unionByName(seg)


def annotation_coverage(records: DataFrame, usage: DataFrame) -> DataFrame:
    """Per group, primer and segment the classified copies of all copies."""
    scope = F.when(F.col("sample_record") == 1, "").otherwise(F.coalesce("primer", F.lit("")))
    total = records.filter("eligible = 1").groupBy(F.col("group_id").alias("_g"), scope.alias("_p")).agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("total_count"))
    d = usage.groupBy(*_KEY).agg(F.max("denominator").alias("classified_count"))
    return d.join(total, F.col("group_id").eqNullSafe(F.col("_g")) & F.col("primer").eqNullSafe(F.col("_p"))).select(*_KEY, "total_count", "classified_count", pct(F.col("classified_count"), F.col("total_count")).alias("coverage_percent"))


def identity_key(*cols: str) -> Column:
    """A hash of what makes two records the same; nan, na, none and null count as ''."""
    plain = [F.when(F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))).isin("nan", "na", "none", "null"), "").otherwise(F.trim(F.coalesce(F.col(c), F.lit("")))) for c in cols]
    return F.sha2(F.concat_ws("\x00", *plain), 256)


def allocate_copies(records: DataFrame, lineage: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(allocations, per group totals).

    lineage: (group_id, identity_key, primer, n) counts of final rows, '' being no primer. A sample
    record's copies go to its identity's primers exactly as counted, if and only if its weight is the
    sum of all those counts and no other sample record of the group has the identity; else none.
    allocations: (group_id, id, primer, copies). totals: copies, allocated and unresolved.
    """
    r = records.filter("sample_record = 1")
    ik = ["group_id", "identity_key"]
    one = _as(r.groupBy(*ik).agg(F.count(F.lit(1)).alias("_times")), ik)
    total = _as(lineage.groupBy(*ik).agg(F.sum("n").alias("_n")), ik, "t_")
    exact = r.join(one, _join_on(ik)).join(total, _join_on(ik, "t_")).filter((F.col("_times") == 1) & (F.col("weight") == F.col("_n"))).select("group_id", "identity_key", "id")
    parts = _as(lineage.filter("primer <> ''"), ik)
    alloc = exact.join(parts, _join_on(ik)).select("group_id", "id", "primer", F.col("n").alias("copies"))
    got = alloc.groupBy(F.col("group_id").alias("_g")).agg(F.sum("copies").alias("allocated"))
    sums = r.groupBy("group_id").agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum("weight"), F.lit(0)).alias("copies"))
    a = F.coalesce("allocated", F.lit(0))
    totals = sums.join(got, F.col("group_id").eqNullSafe(F.col("_g")), "left").select("group_id", "records", "copies", a.alias("allocated"), (F.col("copies") - a).alias("unresolved"))
    return alloc, totals


def scenario_lineage(matched: DataFrame, final: DataFrame, read: list[str]) -> DataFrame:
    """(scenario_id, identity_key, primer, n): the final rows of each scenario's group by the primer that their read
    has in the scenario, '' where the read is not found, found more than once, or has not exactly one primer.
    matched: primers.scenarios() with group_id; final: (group_id, *read, identity_key), a row per final row. read: what
    identifies a read within its group."""
    link = matched.groupBy("scenario_id", *read).agg(
        F.count(F.lit(1)).alias("_times"), F.min(F.when(F.col("match_class") == "unique", F.element_at("names", 1)).otherwise("")).alias("_primer")
    )
    of = matched.select("scenario_id", F.col("group_id").alias("__group_id")).distinct()
    rows = final.select("group_id", *read, "identity_key").join(of, _join_on(["group_id"]))
    same = F.col("scenario_id") == F.col("_scenario_id")
    for c in read:
        same = same & (F.col(c) == F.col(f"_{c}"))
    link = link.select(*(F.col(c).alias(f"_{c}") for c in ("scenario_id", *read)), "_times", "_primer")
    primer = F.when(F.col("_times") == 1, F.col("_primer")).otherwise("").alias("primer")
    return rows.join(link, same, "left").groupBy("scenario_id", "identity_key", primer).agg(F.count(F.lit(1)).alias("n"))


def scenario_records(records: DataFrame, calls: DataFrame, lineage: DataFrame, scenarios: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, calls, totals) of each scenario, whose id is their group_id: the sample records' copies given to the
    scenario's primers by allocate_copies(). The first two go into usage_counts(), gene_usage() and unique_cdr3_counts().
    lineage: scenario_lineage(); scenarios: (scenario_id, group_id)."""
    s = scenarios.select("scenario_id", F.col("group_id").alias("__group_id")).distinct()
    base = records.filter("sample_record = 1").join(s, _join_on(["group_id"])).drop("group_id", "__group_id").withColumnRenamed("scenario_id", "group_id")
    alloc, totals = allocate_copies(base, lineage.withColumnRenamed("scenario_id", "group_id"))
    own = F.sha2(F.to_json(F.struct("group_id", "id", "primer")), 256).alias("_own")
    parts = alloc.select("group_id", "primer", "copies", own, F.col("id").alias("_base"))
    aa = records.filter("sample_record = 1").select(F.col("id").alias("_id"), "aa_field", "aa_value", "aa_valid")
    shares = parts.join(aa, F.col("_base") == F.col("_id")).select(
        F.col("_own").alias("id"), "group_id", "primer", F.lit(0).alias("sample_record"), F.col("copies").alias("weight"), F.lit(1).alias("eligible"), "aa_field", "aa_value", "aa_valid"
    )
    called = parts.join(calls, F.col("_base") == F.col("record_id")).select(F.col("_own").alias("record_id"), "segment", "gene", "assignment")
    return shares, called, totals


def primer_composition(usage: DataFrame) -> DataFrame:
    """Each primer's C genes as percent of its classified C genes."""
    c = usage.filter("segment = 'C' and primer <> ''")
    total = F.sum("unique_count").over(Window.partitionBy("group_id", "primer"))
    return c.select("group_id", "primer", "gene", "unique_count", pct(F.col("unique_count"), total).alias("percent"))


def align_genes(usage: DataFrame, sample: str) -> DataFrame:
    """Genes observed in any of at least two samples of a chain, each sample with its percent (0 where
    the gene is not observed), ordered by the highest percent. usage: (chain, segment, sample, gene, percent)."""
    m = usage.groupBy("chain", "segment").agg(F.countDistinct(sample).alias("k")).filter("k >= 2").select(F.col("chain").alias("_c"), F.col("segment").alias("_s"))
    u = usage.join(m, (F.col("chain") == F.col("_c")) & (F.col("segment") == F.col("_s"))).drop("_c", "_s")
    axis = u.groupBy("chain", "segment", "gene").agg(F.max("percent").alias("max_percent")).filter("max_percent > 0")
    who = u.select(F.col("chain").alias("_c"), F.col("segment").alias("_s"), sample).distinct()
    dense = axis.join(who, (F.col("chain") == F.col("_c")) & (F.col("segment") == F.col("_s"))).drop("_c", "_s")
    v = _as(u.select("chain", "segment", "gene", sample, "percent"), ["chain", "segment", "gene", sample])
    return dense.join(v, _join_on(["chain", "segment", "gene", sample]), "left").select("chain", "segment", "gene", sample, F.coalesce("percent", F.lit(0.0)).alias("percent"), "max_percent")
