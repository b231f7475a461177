"""Stage accounting, guarded totals and sample outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vdjloom.functions.text import pct

# Stage, the stage it is compared with, and whether the units may differ (a merge).
STAGES = (
    ("raw_r1", None, False), ("raw_r2", None, False), ("raw", None, False), ("fastp_r1", "raw_r1", False), ("fastp_r2", "raw_r2", False),
    ("fastp", "raw", False), ("clean", "fastp", False), ("merge_input", None, False), ("merged", "merge_input", True),
)
UNITS = {
    "raw_r1": "reads", "raw_r2": "reads", "raw": "read ends", "fastp_r1": "reads", "fastp_r2": "reads", "fastp": "read ends",
    "clean": "read ends", "merge_input": "read pairs", "merged": "queries", "mapping_input": "queries", "mapping_output": "AIRR rows",
}


def only_value(c: str) -> Column:
    """The group's value if all its rows hold the same non-null one, else null."""
    return F.when((F.min(c) == F.max(c)) & (F.count(c) == F.count(F.lit(1))), F.min(c))


def stage_totals(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(sample, stage, chain, count): the sum over the sample's pairs, null unless every pair has exactly one
    non-null count. rows: (sample, pair, stage, chain, count); pairs: (sample, pair), the pairs in scope."""
    p = pairs.select(F.col("sample").alias("_s"), F.col("pair").alias("_p")).distinct()
    size = p.groupBy("_s").agg(F.count(F.lit(1)).alias("_pairs"))
    per = rows.join(p, (F.col("sample") == F.col("_s")) & (F.col("pair") == F.col("_p"))).groupBy("sample", "pair", "stage", "chain").agg(only_value("count").alias("count"))
    g = per.groupBy("sample", "stage", "chain").agg(F.sum("count").alias("c"), F.count("count").alias("k"))
    return g.join(size, F.col("sample") == F.col("_s")).select("sample", "stage", "chain", F.when(F.col("k") == F.col("_pairs"), F.col("c")).alias("count"), F.col("_pairs").alias("pair_count"))


def stage_volumes(totals: DataFrame) -> DataFrame:
    """A row per sample and stage in the fixed order, with previous count, reduction and retention. raw and fastp
    are the sum of their two ends where both are known. Reduction needs equal units, or the merge."""
    names = [s for s, _, _ in STAGES]
    p = totals.filter("chain = ''").groupBy("sample").pivot("stage", names).agg(F.max("count"))
    for s in ("raw", "fastp"):
        p = p.withColumn(s, F.coalesce(F.col(f"{s}_r1") + F.col(f"{s}_r2"), F.col(s)))
    rows = []
    for i, (s, before, merge) in enumerate(STAGES):
        comparable = before is not None and (merge or UNITS[before] == UNITS[s])
        rows.append(F.struct(
            F.lit(i).alias("position"), F.lit(s).alias("stage"), F.lit(UNITS[s]).alias("unit"), F.col(s).alias("count"), F.lit(before or "").alias("previous_stage"),
            (F.col(before) if before else F.lit(None).cast("bigint")).alias("previous_count"), F.lit(comparable).alias("_ok"),
        ))
    x = p.select("sample", F.explode(F.array(*rows)).alias("r")).select("sample", "r.*")
    ok = F.col("_ok")
    return x.withColumn("reduction", F.when(ok, F.col("previous_count") - F.col("count"))).withColumn("retention_percent", F.when(ok, pct(F.col("count"), F.col("previous_count")))).drop("_ok")


def mapping_volumes(totals: DataFrame) -> DataFrame:
    """Per chain mapping_input against the merged queries, and mapping_output, whose unit differs (no reduction)."""
    merged = totals.filter("stage = 'merged' and chain = ''").select(F.col("sample").alias("_s"), F.col("count").alias("merged"))
    m = totals.filter("chain <> '' and stage in ('mapping_input', 'mapping_output')").join(merged, F.col("sample") == F.col("_s"), "left")
    inp = F.col("stage") == "mapping_input"
    return m.select("sample", "chain", "stage", "count", F.when(inp, F.col("merged")).alias("previous_count"), F.when(inp, F.col("merged") - F.col("count")).alias("reduction"), F.when(inp, pct(F.col("count"), F.col("merged"))).alias("retention_percent"))


def best_evidence(rows: DataFrame, keys: list[str], priority: str, value: str) -> DataFrame:
    """The value of the highest priority, null where that priority has several."""
    w = Window.partitionBy(*keys).orderBy(F.desc(priority))
    top = rows.withColumn("_r", F.rank().over(w)).filter("_r = 1")
    return top.groupBy(*keys).agg(only_value(value).alias(value), F.max(priority).alias(priority))


def legacy_merge_records(rows: DataFrame, source: str, order: str) -> DataFrame:
    """Valid merge summaries: rows with status OK (or none), and old two-row records, in which the first row's
    merge_percent is OK and the next row of the file holds the percentage as sample_id; they count only if that
    percentage agrees with the counts to 0.0051. rows: text columns as read, with file and line order."""
    w = Window.partitionBy(source).orderBy(order)
    nxt = lambda c: F.lead(c).over(w)
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    x = rows.select("*", *(nxt(c).alias(f"_n_{c}") for c in ("sample_id", "pair_id", "input_pairs", "merged_sequences", "merge_percent", "status", "error")))
    before, after = F.expr("try_cast(input_pairs as bigint)"), F.expr("try_cast(merged_sequences as bigint)")
    legacy = (F.col("merge_percent") == "OK") & blank("status") & blank("error") & ~blank("sample_id") & ~blank("pair_id") & F.col("input_pairs").rlike(r"^\d+$") & F.col("merged_sequences").rlike(r"^\d+$")
    percent = F.expr("try_cast(_n_sample_id as double)")
    expected = F.when(before > 0, after * 100.0 / before).otherwise(0.0)
    follows = (F.col("_n_merge_percent") == "OK") & (after <= before) & (F.abs(percent - expected) <= 0.0051)
    for c in ("pair_id", "input_pairs", "merged_sequences", "status", "error"):
        follows = follows & blank(f"_n_{c}")
    plain = ~legacy & (F.upper(F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("OK"))) == "OK") & ~((F.col("merge_percent") == "OK") & blank("pair_id"))
    good = plain | (legacy & F.coalesce(follows, F.lit(False)))
    return x.filter(good).select(source, "sample_id", "pair_id", before.alias("input_pairs"), after.alias("merged_sequences"), F.when(legacy, F.col("_n_sample_id")).otherwise(F.col("merge_percent")).alias("merge_percent"), legacy.alias("repaired"))


def summary_roll_up(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Batches of a chain in one row: counts add up, the worst status (ERROR, OK, EMPTY) stays, percent with two decimals."""
    rank = F.when(F.col("status") == "ERROR", 0).when(F.col("status") == "OK", 1).otherwise(2)
    g = rows.groupBy(*keys).agg(F.sum("input_sequences").alias("input_sequences"), F.sum("mapped_rows").alias("mapped_rows"), F.min(rank).alias("_s"), F.count(F.lit(1)).alias("batches"))
    status = F.when(F.col("_s") == 0, "ERROR").when(F.col("_s") == 1, "OK").otherwise("EMPTY")
    return g.withColumn("status", status).withColumn("mapped_percent", F.round(pct(F.col("mapped_rows"), F.col("input_sequences")), 2)).drop("_s")


def sample_outputs(items: DataFrame, merged: DataFrame, metrics: DataFrame) -> DataFrame:
    """Per sample and chain total reads, receptor RNA and unique CDR3s with status complete, partial or unavailable
    and the reasons. items: (sample, chain, pair); merged: (sample, pair, count); metrics: (sample, chain, source,
    umi_counts, unique_cdr3), whose row counts only if it is the only one."""
    per = merged.groupBy("sample", "pair").agg(only_value("count").alias("c"))
    pairs = items.select("sample", "chain", "pair").distinct()
    t = pairs.join(per, ["sample", "pair"], "left").groupBy("sample", "chain").agg(F.sum("c").alias("s"), F.count("c").alias("k"), F.count(F.lit(1)).alias("n"))
    m = metrics.groupBy("sample", "chain").agg(F.count(F.lit(1)).alias("_m"), F.min("umi_counts").alias("_u"), F.min("unique_cdr3").alias("_x"))
    j = t.join(m, ["sample", "chain"], "left")
    one = F.coalesce(F.col("_m"), F.lit(0)) == 1
    reads = F.when(F.col("k") == F.col("n"), F.col("s"))
    rna, cdr3 = F.when(one & (F.col("_u") >= 0), F.col("_u")), F.when(one & (F.col("_x") >= 0), F.col("_x"))
    why = F.concat_ws("; ", F.when(reads.isNull(), F.lit("Merged count unavailable")), F.when(F.col("_m").isNull(), F.lit("AIRR preprocessing unavailable")), F.when(F.col("_m") > 1, F.lit("Multiple preprocessing batches; select one batch")), F.when(one & (rna.isNull() | cdr3.isNull()), F.lit("AIRR metric missing or invalid")))
    status = F.when(why == "", "complete").when(F.coalesce(reads, rna, cdr3).isNotNull(), "partial").otherwise("unavailable")
    return j.select("sample", "chain", reads.alias("total_reads"), rna.alias("total_receptor_rna"), cdr3.alias("total_unique_cdr3s"), status.alias("status"), why.alias("note"))


def stage_matrix(totals: DataFrame) -> DataFrame:
    """Each stage as percent of its sample's largest count, and its change against the stage before."""
    w = Window.partitionBy("sample", "chain")
    x = totals.filter("count is not null").withColumn("of_max_percent", pct(F.col("count"), F.max("count").over(w)))
    before = F.lag("count").over(w.orderBy("position"))
    return x.withColumn("change", F.col("count") - before).withColumn("retained_percent", pct(F.col("count"), before))


def duplicates_as_errors(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The second and later rows of a key become ERROR."""
    w = Window.partitionBy(*keys).orderBy(*order)
    n = F.row_number().over(w)
    return rows.withColumn("status", F.when(n > 1, "ERROR").otherwise(F.col("status"))).withColumn("error", F.when(n > 1, "duplicate mapping").otherwise(F.col("error")))


def status_counts(jobs: DataFrame, groups: list[str], statuses: list[str]) -> DataFrame:
    """Rows per group in total and by status."""
    return jobs.groupBy(*groups).agg(F.count(F.lit(1)).alias("total"), *(F.sum((F.col("status") == s).cast("int")).cast("bigint").alias(s.lower()) for s in statuses))


def processing_manifest(outputs: DataFrame) -> DataFrame:
    """A row per input_root and relative_sample: sample, batch, available_receptors (joined by commas), tcr_path, bcr_path,
    n_rows, state_total_rows, state_matched_rows, state_unmatched_rows, row_contract_valid, status and error.
    outputs: (input_root, relative_sample, sample, batch, receptor, path, n_rows, state_total_rows, state_matched_rows, state_unmatched_rows,
    umi_source, error), a row per sample and receptor. status: ERROR with any error, EMPTY without rows, else OK."""
    some = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    path = lambda r: F.coalesce(F.min(F.when(F.col("receptor") == r, F.col("path"))), F.lit("")).alias(f"{r.lower()}_path")
    g = outputs.groupBy("input_root", "relative_sample", "sample", "batch").agg(
        F.array_join(F.array_sort(F.collect_set("receptor")), ",").alias("available_receptors"), path("TCR"), path("BCR"), F.min("umi_source").alias("umi_source"),
        some("n_rows"), F.max("state_total_rows").alias("state_total_rows"), some("state_matched_rows"), some("state_unmatched_rows"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("error") != "", F.col("error")))), "; ").alias("error"),
    )
    status = F.when(F.col("error") != "", "ERROR").when(F.col("n_rows") == 0, "EMPTY").otherwise("OK")
    valid = (F.col("umi_source") == "row_contract") & (F.col("error") == "")
    return g.withColumn("row_contract_valid", F.when(valid, "1").otherwise("0")).withColumn("status", status)
