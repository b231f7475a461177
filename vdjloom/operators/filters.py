"""Row filters with reasons (F01-F08, F34-F36) and locus splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vdjloom.functions.text import is_bad_call, strip
from vdjloom.schemas import CHAINS

# The thresholds of the AIRR filter.
MIN_V_SCORE, MIN_V_IDENTITY, TCR_SHARE, TCR_IDENTITY = 150, 85, 0.9, 99.7


def _productive(c: str = "productive") -> Column:
    return F.coalesce(F.upper(strip(c)).isin("T", "TRUE"), F.lit(False))


def _tcr_rule(df: DataFrame, frame: list[str]) -> DataFrame:
    """Frames in which more than TCR_SHARE of the rows have a TR locus keep only identities from
    TCR_IDENTITY on. The share is one small row per frame."""
    is_tr = F.when(F.contains(F.col("locus"), F.lit("TR")), 1).otherwise(0)
    share = df.groupBy(*(F.col(f).alias(f"__{f}") for f in frame)).agg((F.sum(is_tr) / F.count(F.lit(1))).alias("_tr"))
    same = F.lit(True)
    for f in frame:
        same = same & F.col(f).eqNullSafe(F.col(f"__{f}"))
    return df.join(share, same).filter((F.col("_tr") <= TCR_SHARE) | (F.col("v_identity") >= TCR_IDENTITY)).select(*df.columns)


def airr_filter(df: DataFrame, frame: list[str]) -> DataFrame:
    """F01 with A01: the distinct rows that pass, with umi_counts = passing rows of the same
    sequence before the distinct (every distinct row of a sequence gets the full count).

    frame: the columns of one sample's table; counts and the TCR rule hold within it.
    sequence_id is dropped. Null locus, productive other than T, scores of 150 and less,
    identities of 85 and less, and rows without any V and J call are left out.
    Repeated rows are combined map-side before anything is shuffled, with their number.
    """
    keep = (
        F.col("locus").isNotNull() & (F.col("productive") == "T") & (F.col("v_score") > MIN_V_SCORE)
        & (F.col("v_identity") > MIN_V_IDENTITY) & (F.col("v_call").isNotNull() | F.col("j_call").isNotNull())
    )
    cols = [c for c in df.columns if c not in ("sequence_id", "umi_counts")]
    rows = df.filter(keep).groupBy(*cols).agg(F.count(F.lit(1)).alias("_times"))
    per = rows.groupBy(*(F.col(c).alias(f"__{c}") for c in [*frame, "sequence"])).agg(F.sum("_times").alias("umi_counts"))
    same = F.col("sequence").eqNullSafe(F.col("__sequence"))
    for f in frame:
        same = same & F.col(f).eqNullSafe(F.col(f"__{f}"))
    return _tcr_rule(rows.join(per, same).select(*cols, "umi_counts"), frame)


def droplet_filter(df: DataFrame, frame: list[str]) -> DataFrame:
    """as F01 for droplet tables: needs barcode, locus, sequence and a positive count; no
    distinct; the TCR rule looks at the filtered rows."""
    full = lambda c: F.coalesce(strip(c) != "", F.lit(False))
    keep = (
        full("barcode") & full("locus") & full("sequence") & (F.col("umi_counts") > 0) & _productive()
        & (F.col("v_score") > MIN_V_SCORE) & (F.col("v_identity") > MIN_V_IDENTITY) & (~is_bad_call("v_call") | ~is_bad_call("j_call"))
    )
    return _tcr_rule(df.filter(keep), frame)


def mapping_reason(chain: Column | str) -> Column:
    """why a mapped row is kept or not, by the first rule that applies. The row's locus is
    compared with the target chain, which may differ by row."""
    locus = F.coalesce(F.upper(strip("locus")), F.lit(""))
    chain = F.upper(strip(chain))
    return (
        F.when(is_bad_call("v_call"), "no_v_call").when(~_productive(), "nonproductive_or_unknown")
        .when(~locus.isin(*CHAINS), "unknown_locus").when(~locus.eqNullSafe(chain), "different_locus").otherwise("retained")
    )


def mapping_report(df: DataFrame, groups: list[str], chain: str) -> DataFrame:
    """per group the counters of the mapping filter."""
    good_v, good_p = ~is_bad_call("v_call"), _productive()
    r = mapping_reason(chain)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    return df.withColumn("_r", r).groupBy(*groups).agg(
        F.count(F.lit(1)).alias("raw_rows"), n(good_v).alias("mapped_rows"), n(good_p).alias("productive_rows"),
        n(F.col("_r") == "retained").alias("output_rows"), n(good_v & good_p).alias("locus_input_rows"),
        n(F.col("_r").isin("unknown_locus", "different_locus")).alias("excluded_locus_rows"),
        n(F.col("_r") == "unknown_locus").alias("unknown_locus_rows"),
    )


def remapping_filter(df: DataFrame) -> DataFrame:
    """a valid V call and productive T or TRUE."""
    return df.filter(~is_bad_call("v_call") & _productive())


def locus_split(df: DataFrame, chain: str) -> DataFrame:
    """the rows of one chain."""
    if chain not in CHAINS:
        raise ValueError(f"unknown chain: {chain}")
    return df.filter(F.upper(strip("locus")) == chain)


def retained_subsets(df: DataFrame, reason: str = "filter_reason") -> DataFrame:
    """every row in subset 'all', and again in 'retained' if its reason says so."""
    kept = F.coalesce(F.col(reason).isin("retained", "retained_history", "imported_result"), F.lit(False))
    return df.withColumn("subset", F.explode(F.when(kept, F.array(F.lit("all"), F.lit("retained"))).otherwise(F.array(F.lit("all")))))
