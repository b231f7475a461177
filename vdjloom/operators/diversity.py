"""Repertoire diversity and expression.

Every index is a function of how many rows have which weight, so the rows are first
aggregated to (group, weight, rows): at most about sqrt(2 * total weight) rows per group,
whatever its number of rows. Ordered indices (D50, Gini) run over that histogram.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("D50", "Largest_clone_percent", "Shannon_index", "Pielou_evenness", "Gini_index", "Simpson_index", "Simpson_evenness")


def _equal(keys: list[str], other: str):
    c = F.lit(True)
    for k in keys:
        c = c & F.col(k).eqNullSafe(F.col(f"{other}{k}"))
    return c


def expression(df: DataFrame, frame: list[str], weight: str = "umi_counts") -> DataFrame:
    """Per locus of a frame its weight, distinct non-null CDR3s and share of the frame's weight.
    The distinct count is two-level: (locus, cdr3) first, so a hot locus is spread."""
    per = df.groupBy(*frame, "locus", "cdr3_aa").agg(F.sum(weight).alias("_w"))
    loci = per.groupBy(*frame, "locus").agg(F.sum("_w").cast("bigint").alias("umi_counts"), F.count("cdr3_aa").alias("unique_cdr3"))
    total = F.sum("umi_counts").over(Window.partitionBy(*frame))
    return loci.withColumn("share", F.when(total != 0, F.col("umi_counts").cast("double") / total.cast("double")))


def diversity(df: DataFrame, keys: list[str], weight: str = "umi_counts", cdr3: str = "cdr3_aa", base: float | None = None, gini: str = "rectangles") -> DataFrame:
    """D01-D07 per key: (*keys, n_rows, total, and a column for each of METRICS).

    Weights are positive whole numbers per row; null, zero and negative weights are left out.
    base: of the Shannon logarithm, natural by default. gini: the area under the Lorenz curve
    by rectangles (not below 0) or trapezoids. One row: Pielou evenness is null. No non-null CDR3: the largest clone is null.
    """
    rows = df.filter(F.col(weight) > 0)
    hist = rows.groupBy(*keys, F.col(weight).cast("bigint").alias("w")).agg(F.count(F.lit(1)).alias("m"))
    whole = Window.partitionBy(*keys)
    mass = (F.col("w") * F.col("m")).alias("mass")
    h = hist.select("*", mass).withColumn("T", F.sum("mass").over(whole)).withColumn("n", F.sum("m").over(whole))
    down = whole.orderBy(F.desc("w")).rowsBetween(Window.unboundedPreceding, -1)
    up = whole.orderBy(F.asc("w")).rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("above", F.coalesce(F.sum("mass").over(down), F.lit(0))).withColumn("below", F.coalesce(F.sum("mass").over(up), F.lit(0)))
    # rows of this weight whose running sum, in descending order, stays within half the total
    fit = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("m"), F.expr("(T - 2 * above) div (2 * w)")))
    # sum of the running sums of this weight's rows, in ascending order
    lorenz = F.col("m") * F.col("below").cast("double") + F.col("w") * F.col("m") * (F.col("m") + 1) / 2.0
    p = F.col("w").cast("double") / F.col("T").cast("double")
    g = h.groupBy(*keys).agg(
        F.max("n").alias("n_rows"), F.max("T").alias("total"), F.sum(fit).alias("_half"),
        F.sum(-F.col("m") * p * F.log(p)).alias("_h"), F.sum(F.col("m") * p * p).alias("_p2"), F.sum(lorenz).alias("_lorenz"),
    )
    clones = rows.filter(F.col(cdr3).isNotNull()).groupBy(*keys, cdr3).agg(F.sum(weight).alias("_c"))
    largest = clones.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg((F.max("_c").cast("double") / F.sum("_c").cast("double")).alias("_largest"))
    n, t = F.col("n_rows").cast("double"), F.col("total").cast("double")
    area = F.greatest(F.lit(0.0), 1.0 - 2.0 * F.col("_lorenz") / (n * t))
    if gini == "trapezoids":
        area = 1.0 - 2.0 * F.col("_lorenz") / (n * t) + 1.0 / n
    elif gini != "rectangles":
        raise ValueError("gini: rectangles or trapezoids")
    scale = 1.0 if base is None else F.log(F.lit(float(base)))
    return g.join(largest, _equal(keys, "__"), "left").select(
        *keys, "n_rows", "total",
        (F.col("_half") * 100.0 / n).alias("D50"), F.col("_largest").alias("Largest_clone_percent"),
        (F.col("_h") / scale).alias("Shannon_index"), F.when(n > 1, F.col("_h") / F.log(n)).alias("Pielou_evenness"),
        area.alias("Gini_index"),
        (1.0 - F.col("_p2")).alias("Simpson_index"), (1.0 / F.col("_p2") / n).alias("Simpson_evenness"),
    )


def long_metrics(wide: DataFrame, keys: list[str], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(*keys, metric, value), a row per metric, null values included."""
    pairs = ", ".join(f"'{m}', cast(`{m}` as double)" for m in metrics)
    return wide.select(*keys, F.expr(f"stack({len(metrics)}, {pairs}) as (metric, value)"))


def wide_metrics(long: DataFrame, row: list[str], names: list[str]) -> DataFrame:
    """A row per sample with one column per named metric; the first value counts (the
    least, so that it is the same on every run). The names are given, so no pass looks for them."""
    return long.groupBy(*row).pivot("metric", names).agg(F.min("value"))


def report_metrics(long: DataFrame) -> DataFrame:
    """The values as the report shows them, with unit and status: D50 and the largest clone in percent."""
    v = F.when(F.col("metric") == "Largest_clone_percent", F.col("value") * 100).otherwise(F.col("value"))
    unit = F.when(F.col("metric").isin("D50", "Largest_clone_percent"), "%").otherwise("index")
    ok = F.col("value").isNotNull() & ~F.isnan("value")
    return long.withColumn("value", F.when(ok, v)).withColumn("unit", unit).withColumn("status", F.when(ok, "complete").otherwise("unavailable"))
