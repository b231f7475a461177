"""Single-cell chains: clustering, retention and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vdjloom.functions.calls import normal_gene, normal_nt
from vdjloom.functions.text import strip

# When a second candidate is kept beside the first.
DOMINANT_RATIO, MIN_FRACTION = 3.0, 0.10
MISSING_CDR3 = "__MISSING_CDR3__"


def supported(top: Column, second: Column, ratio: float = DOMINANT_RATIO, fraction: float = MIN_FRACTION) -> Column:
    """top/second below `ratio`, or second at least `fraction` of both."""
    return (top > 0) & (second > 0) & ((top / second < ratio) | (second / (top + second) >= fraction))


def coverage() -> Column:
    """Bases covered by the V, D, J and C spans whose ends are both known."""
    spans = [F.when(F.col(f"{s}_alignment_end") >= F.col(f"{s}_alignment_start"), F.col(f"{s}_alignment_end") - F.col(f"{s}_alignment_start") + 1) for s in "vdjc"]
    out = F.lit(0)
    for s in spans:
        out = out + F.coalesce(s, F.lit(0))
    return out


def with_keys(df: DataFrame) -> DataFrame:
    """The cluster and variant keys and the quality of each row. A row without a CDR3 clusters
    with its own variant only."""
    variant = F.when(normal_nt("sequence_alignment") != "", normal_nt("sequence_alignment")).otherwise(normal_nt("sequence"))
    read = F.when(F.coalesce(F.col("sequence_alignment"), F.lit("")) != "", F.col("sequence_alignment")).otherwise(F.col("sequence"))
    low = F.lit(float("-inf"))
    return df.select(
        "*", normal_gene("v_call").alias("_v"), normal_gene("j_call").alias("_j"), variant.alias("_variant"), coverage().alias("_cov"),
        F.coalesce("v_score", low).alias("_score"), F.coalesce("v_identity", low).alias("_identity"), F.length(normal_nt(read)).alias("_len"),
    ).withColumn("_cdr3", F.when(normal_nt("cdr3") != "", normal_nt("cdr3")).otherwise(F.concat(F.lit(MISSING_CDR3), F.col("_variant"))))


def cluster_chains(df: DataFrame, cell: list[str], order: str, max_chains: int = 2, max_variants: int = 2) -> tuple[DataFrame, DataFrame]:
    """(chains, summary).

    A cluster is one V, J and CDR3 of a cell and locus; a variant one sequence of it, shown by its
    best row (coverage, score, identity, length, earliest). Clusters rank by support (sum of
    umi_counts), best quality, earliest row; rank 1 stays (PRIMARY), rank 2 if supported
    (SECONDARY_SUPPORTED, else SECONDARY_DOMINATED), others go (EXCESS_CHAIN_CANDIDATE). A kept
    cluster gives its first variant, and the second if supported; umi_counts is the variant's.
    `order`: a column with the row's place in its source; it settles ties.

    Rows are first reduced to one per variant with map-side combine, so a hot cell is its variants,
    not its rows. Variants are then placed by cell and locus once; every window after that (by
    cluster, by cell) is served by that placement, and clusters are never joined back.
    """
    rows = with_keys(df)
    cl = [*cell, "locus", "_v", "_j", "_cdr3"]
    q = ["_cov", "_score", "_identity", "_len"]
    best = F.max(F.struct(*q, (-F.col(order)).alias("_o"), *(c for c in ("v_call", "j_call", "c_call", "cdr3", "cdr3_aa", "sequence") if c in df.columns)))
    v = rows.groupBy(*cl, "_variant").agg(best.alias("b"), F.sum("umi_counts").alias("support"), F.min(order).alias("_first"))
    v = v.repartition(*(F.col(c) for c in (*cell, "locus")))
    cluster = Window.partitionBy(*cl)
    ranked = cluster.orderBy(F.desc("support"), *(F.desc(f"b.{c}") for c in q), F.desc("b._o"))
    v = v.withColumn("variant_rank", F.row_number().over(ranked))
    at = lambda k, c: F.max(F.when(F.col("variant_rank") == k, F.col(c))).over(cluster)
    v = v.withColumns({
        "_support": F.sum("support").over(cluster), "_q": F.max(F.struct(*(F.col(f"b.{c}") for c in q))).over(cluster), "_start": F.min("_first").over(cluster),
        "all_variants": F.count(F.lit(1)).over(cluster), "_s1": at(1, "support"), "_s2": at(2, "support"),
    })
    by_cell = Window.partitionBy(*cell, "locus").orderBy(F.desc("_support"), *(F.desc(f"_q.{c}") for c in q), F.asc("_start"), "_v", "_j", "_cdr3")
    v = v.withColumn("chain_rank", F.dense_rank().over(by_cell)).withColumn("_top", F.first("_support").over(by_cell))
    reason = (
        F.when((F.col("chain_rank") == 1) & F.lit(max_chains > 0), "PRIMARY").when(F.col("chain_rank") > max_chains, "EXCESS_CHAIN_CANDIDATE")
        .when(supported(F.col("_top"), F.col("_support")), "SECONDARY_SUPPORTED").otherwise("SECONDARY_DOMINATED")
    )
    v = v.withColumn("retention_reason", reason).withColumn("retained", F.col("retention_reason").isin("PRIMARY", "SECONDARY_SUPPORTED"))
    second = F.coalesce(supported(F.col("_s1"), F.col("_s2")), F.lit(False)) & F.lit(max_variants > 1)
    v = v.withColumn("output_variants", F.when(~F.col("retained") | F.lit(max_variants < 1), 0).when(second, 2).otherwise(1))
    summary = v.filter("variant_rank = 1").select(*cell, "locus", "chain_rank", "b.v_call", "b.j_call", "b.cdr3", F.col("_support").alias("cluster_umi_counts"), "all_variants", "output_variants", "retained", "retention_reason")
    chains = v.filter(F.col("variant_rank") <= F.col("output_variants")).select(*cell, "locus", "chain_rank", "variant_rank", "b.v_call", "b.j_call", "b.cdr3", F.col("b.sequence").alias("sequence"), F.col("support").alias("umi_counts"))
    return chains, summary


def sequence_chain_summary(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Per sequence id the TRA and TRB rows: count, sum, max, the values in source order, and which
    chains it has. umi_counts that are no non-negative whole number make the id's status ERROR."""
    n = F.expr("try_cast(trim(umi_counts) as bigint)") if dict(df.dtypes)["umi_counts"] == "string" else F.col("umi_counts").cast("bigint")
    locus = F.upper(strip("locus"))
    x = df.select(F.col(key), F.when(locus.isin("TRA", "TRB"), locus).otherwise("other").alias("l"), n.alias("n"), F.struct(*order).alias("o"))
    x = x.withColumn("ok", F.coalesce(F.col("n") >= 0, F.lit(False)))
    aggs = [F.count(F.lit(1)).alias("source_rows")]
    for l in ("TRA", "TRB", "other"):
        hit = F.col("ok") & (F.col("l") == l)
        aggs += [
            F.sum(F.when(hit, 1).otherwise(0)).alias(f"{l}_rows"), F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias(f"{l}_sum"), F.coalesce(F.max(F.when(hit, F.col("n"))), F.lit(0)).alias(f"{l}_max"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.when(hit, F.struct("o", "n")))), lambda v: v["n"].cast("string")), ";").alias(f"{l}_values"),
        ]
    aggs.append(F.max(F.when(~F.col("ok"), 1).otherwise(0)).alias("_bad"))
    a, b = F.col("TRA_rows") > 0, F.col("TRB_rows") > 0
    status = F.when(a & b, "BOTH").when(a, "TRA_ONLY").when(b, "TRB_ONLY").otherwise("NO_TRA_TRB")
    return x.groupBy(key).agg(*aggs).withColumn("chain_status", status).withColumn("status", F.when(F.col("_bad") == 1, "ERROR").otherwise("OK")).drop("_bad", "other_sum", "other_max")
