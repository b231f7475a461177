"""UMI operators: representatives, indexes, barcode tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vdjloom.functions.headers import aliases


def sequence_counts(reads: DataFrame, keys: list[str], ordinal: str = "ordinal") -> DataFrame:
    """One row per key and sequence: reads, mean quality and errors over the reads that have them,
    the lexicographically least header (R03) and the first ordinal. Combines map-side, so a
    UMI with very many reads is a handful of rows in the shuffle."""
    return reads.groupBy(*keys, "sequence").agg(
        F.count(F.lit(1)).alias("n"), F.avg("mean_quality").alias("mean_quality"), F.avg("expected_errors").alias("expected_errors"),
        F.min("header").alias("header"), F.min(ordinal).alias("first_ordinal"),
    )


def representatives(counts: DataFrame, keys: list[str], droplet: bool = False) -> DataFrame:
    """The representative sequence of each key with its audit columns.

    Candidates have the highest count. With any quality among them: fewest expected errors
    (missing last), highest mean quality, fewest N, sequence; without: fewest N, sequence.
    ambiguity: CLEAR, RESOLVED_BY_QUALITY, TIED_AFTER_QUALITY or TIED_NO_QUALITY. percent has two
    decimals. droplet: a single candidate with quality is selected by COUNT.
    """
    key = Window.partitionBy(*keys)
    n_count = F.length("sequence") - F.length(F.regexp_replace("sequence", "N", ""))
    c = counts.withColumn("_max", F.max("n").over(key)).withColumn("_total", F.sum("n").over(key)).withColumn("_seqs", F.count(F.lit(1)).over(key)).filter("n = _max")
    c = c.withColumn("_ns", n_count).withColumn("_q", F.max((F.col("expected_errors").isNotNull() | F.col("mean_quality").isNotNull()).cast("int")).over(key) == 1)
    quality = [
        F.when(F.col("_q"), F.col("expected_errors").isNull().cast("int")).asc(), F.when(F.col("_q"), F.col("expected_errors")).asc_nulls_last(),
        F.when(F.col("_q"), F.col("mean_quality")).desc_nulls_last(), F.col("_ns").asc(),
    ]
    best = key.orderBy(*quality)
    c = c.withColumn("_tie", F.rank().over(best)).withColumn("_top", F.count(F.lit(1)).over(key)).withColumn("_ties", F.sum((F.col("_tie") == 1).cast("int")).over(key))
    c = c.withColumn("_rn", F.row_number().over(key.orderBy(*quality, F.col("sequence").asc()))).filter("_rn = 1")
    status = F.when(F.col("_top") == 1, "CLEAR").when(~F.col("_q"), "TIED_NO_QUALITY").when(F.col("_ties") > 1, "TIED_AFTER_QUALITY").otherwise("RESOLVED_BY_QUALITY")
    method = F.when(~F.col("_q"), "COUNT_ONLY_NO_QUALITY").otherwise("COUNT_THEN_QUALITY")
    if droplet:
        method = F.when(F.col("_q") & (F.col("_top") == 1), "COUNT").otherwise(method)
    rep_id = F.concat(F.lit("REP_"), F.substring(F.sha2(F.concat_ws("\x00", *(F.col(k).cast("string") for k in keys)), 256), 1, 24))
    return c.select(
        rep_id.alias("representative_id"), *keys, F.col("_total").alias("total_reads"), F.col("n").alias("representative_reads"),
        F.round(F.col("n") * 100.0 / F.col("_total"), 2).alias("percent"), F.col("_seqs").alias("unique_sequences"), F.col("_top").alias("top_candidates"),
        status.alias("ambiguity"), method.alias("selection_method"), "sequence", "header",
    )


def alternatives(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Per key with several top candidates their list 'sequence:count', in order of first sight.
    The list is as long as there are tied candidates; it is an audit text by nature."""
    key = Window.partitionBy(*keys)
    top = counts.withColumn("_max", F.max("n").over(key)).filter("n = _max")
    g = top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("first_ordinal", "sequence", "n"))).alias("a")).filter(F.size("a") > 1)
    return g.select(*keys, F.array_join(F.transform("a", lambda x: F.concat_ws(":", x["sequence"], x["n"].cast("string"))), ";").alias("alternatives"))


def ambiguity_summary(reps: DataFrame, group: list[str]) -> DataFrame:
    """UMIs per group, how many are ambiguous, and their percentage."""
    a = F.sum((F.col("ambiguity") != "CLEAR").cast("int"))
    return reps.groupBy(*group).agg(F.count(F.lit(1)).alias("umis"), a.alias("ambiguous_umis"), F.round(a * 100.0 / F.count(F.lit(1)), 2).alias("ambiguous_percent"))


def barcode_rank(reads: DataFrame, sample: list[str]) -> DataFrame:
    """Reads and distinct UMIs per barcode, ranked by UMIs, then reads, then barcode."""
    per = reads.groupBy(*sample, "barcode", "umi").agg(F.count(F.lit(1)).alias("k"))
    b = per.groupBy(*sample, "barcode").agg(F.sum("k").alias("reads"), F.count("umi").alias("umi_count"))
    from vdjloom.operators.ranking import running

    r = running(b.withColumn("_one", F.lit(1).cast("bigint")), sample, [F.desc("umi_count"), F.desc("reads"), F.asc("barcode")], "_one", "rank", "_r")
    return r.drop("_one", "_r")


def barcode_stats(reps: DataFrame, barcode: list[str]) -> DataFrame:
    """Per barcode UMIs, reads, mean and median representative percent, mean reads and
    sequences per UMI; two decimals, half to even."""
    two = lambda c: F.rint(c * 100) / 100
    return reps.groupBy(*barcode).agg(
        F.count(F.lit(1)).alias("umi_count"), F.sum("total_reads").alias("total_reads"), two(F.avg("percent")).alias("mean_percent"),
        two(F.median("percent")).alias("median_percent"), two(F.avg("total_reads")).alias("mean_reads"), two(F.avg("unique_sequences")).alias("mean_sequences"),
    )


def alias_index(state: DataFrame, sample: str, ids: str, umi: str) -> DataFrame:
    """Every alias of each read id with its UMI, each triple once. Aliases are keys of an
    exploded equi-join, so nothing is compared pairwise."""
    return state.select(F.col(sample).alias("sample_id"), F.explode(aliases(ids)).alias("alias"), F.col(umi).alias("umi")).filter("umi is not null").distinct()


def lookup_umi(queries: DataFrame, sample: str, ids: str, index: DataFrame) -> DataFrame:
    """(sample, id, umi, status): the UMI of each query id if all of its aliases agree on exactly
    one: matched; several: conflict; none: missing (umi null then)."""
    q = queries.select(F.col(sample).alias("_s"), F.col(ids).alias("_id")).distinct()
    hit = q.select("_s", "_id", F.explode(aliases("_id")).alias("_a")).join(index, (F.col("_s") == F.col("sample_id")) & (F.col("_a") == F.col("alias")))
    found = hit.groupBy("_s", "_id").agg(F.min("umi").alias("lo"), F.max("umi").alias("hi"))
    f = found.select(F.col("_s").alias("_s2"), F.col("_id").alias("_id2"), "lo", "hi")
    status = F.when(F.col("lo").isNull(), "missing").when(F.col("lo") == F.col("hi"), "matched").otherwise("conflict")
    return q.join(f, F.col("_s").eqNullSafe(F.col("_s2")) & F.col("_id").eqNullSafe(F.col("_id2")), "left").select(
        F.col("_s").alias(sample), F.col("_id").alias(ids), F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("umi"), status.alias("status")
    )


def first_or_conflict(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The only value of each key, or null and conflict = true where there are several. Null values are ignored."""
    g = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return g.select(*keys, F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias(value), F.coalesce(F.col("_lo") != F.col("_hi"), F.lit(False)).alias("conflict"))


def pair_reads(r1: DataFrame, r2: DataFrame, ordinal: list[str], key: str) -> DataFrame:
    """R1 and R2 by ordinal, each pair with state paired, key_mismatch, missing_r1 or missing_r2."""
    a = r1.select(*(F.col(o).alias(f"_a_{o}") for o in ordinal), F.col(key).alias("_ka"))
    b = r2.select(*(F.col(o).alias(f"_b_{o}") for o in ordinal), F.col(key).alias("_kb"))
    same = F.lit(True)
    for o in ordinal:
        same = same & (F.col(f"_a_{o}") == F.col(f"_b_{o}"))
    state = F.when(F.col(f"_a_{ordinal[0]}").isNull(), "missing_r1").when(F.col(f"_b_{ordinal[0]}").isNull(), "missing_r2").when(F.col("_ka").eqNullSafe(F.col("_kb")), "paired").otherwise("key_mismatch")
    return a.join(b, same, "full").select(*(F.coalesce(f"_a_{o}", f"_b_{o}").alias(o) for o in ordinal), F.col("_ka").alias("r1_key"), F.col("_kb").alias("r2_key"), state.alias("state"))
