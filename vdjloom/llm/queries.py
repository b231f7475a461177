"""The pN queries of the llm operators, with production parameters on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vdjloom.functions.text import sql_strip, value_key
from vdjloom.llm import bitmaps, frequent, mixing, packing, reading, tokens, top_n
from vdjloom.plans.durable import settle
from vdjloom.sources.tables import once, table


def _heavy_values(spark: SparkSession, d: str, k: int) -> DataFrame:
    r = table(spark, d, "composition_records").filter("sample_record = 1 and aa_valid = 1 and weight > 0")
    r = once(r, "id", value_key("aa_value").alias("value"), "weight").filter("value is not null")
    return frequent.frequent_items(r, "value", "weight", k)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    # 100 values at most can each hold 1 % of the weight
    top = _heavy_values(spark, d, 100)
    return top.filter(F.col("weight").cast("decimal(38,0)") * 100 >= F.col("total_weight")).select(F.col("value").alias("aa_value"))


def p1_top_values(spark: SparkSession, d: str) -> DataFrame:
    return _heavy_values(spark, d, 1000).select("rank", F.col("value").alias("aa_value"), F.col("weight").alias("total_weight"), F.col("n_rows"))


def _top_identities(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "composition_records").filter("sample_record = 1 and weight > 0")
    return top_n.top_n(once(r, "id", "group_id", "identity_key", "weight"), "group_id", "identity_key", "weight", 10)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _top_identities(spark, d).select(F.col("group_key").alias("group_id"), F.col("item_key").alias("identity_key"))


def p2_top_identities(spark: SparkSession, d: str) -> DataFrame:
    return _top_identities(spark, d).select(F.col("group_key").alias("group_id"), F.col("item_key").alias("identity_key"), F.col("score").cast("bigint").alias("total_weight"), "rank")


_DIMS = ["day", "group_id", "primer"]


def _values(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "composition_records")
    day = F.date_format(F.coalesce("created_at", "loaded_at"), "yyyy-MM-dd").alias("day")
    primer = F.coalesce("primer", F.lit("")).alias("primer")
    return once(r.filter("aa_value is not null"), "id", day, "group_id", primer, value_key("aa_value").alias("value")).filter("value is not null")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "composition_records").filter("aa_value is not null")
    rows = once(r, "id", "group_id", F.coalesce("primer", F.lit("")).alias("primer"), value_key("aa_value").alias("value"))
    # rows as delivered: never fewer than the distinct values, and counted without a shuffle of the values
    most = max(bitmaps.LEAST_MAX, r.count())
    return bitmaps.strongly_repeating(rows, ["group_id", "primer"], "value", n_max=most, settle=settle).select("group_id", "primer")


def _counts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    # rows as delivered, as in p5_found
    most = max(bitmaps.LEAST_MAX, table(spark, d, "composition_records").filter("aa_value is not null").count())
    v = _values(spark, d)
    return v, bitmaps.distinct_counts(v, _DIMS, "value", 0.02, most, settle)


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    e = _counts(spark, d)[1]
    return e.select("grouping", *_DIMS, "n_rows", F.round("estimate", 2).alias("estimate"), F.round("std_error", 6).alias("std_error"))


def p5_accuracy(spark: SparkSession, d: str) -> DataFrame:
    v, e = _counts(spark, d)
    return bitmaps.outside(v, _DIMS, "value", settle(e), settle)


def _sizes(spark: SparkSession, d: str, *more) -> DataFrame:
    docs = tokens.with_tokens(table(spark, d, "documents").select("doc_id", "text", *more))
    return docs.drop("text")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(settle(_sizes(spark, d)), settle=settle)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.in_several(_packed(spark, d))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(_packed(spark, d))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    sizes = settle(_sizes(spark, d, mixing.source_name("source").alias("source_key")))
    targets = table(spark, d, "mix_targets")
    return sizes, targets, mixing.mix(sizes, targets, settle)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    # read off the mix: all documents taken as often as allowed, and still less than wanted
    return mixing.report(*_mix(spark, d)).filter("exhausted and mixed_tokens < wanted_tokens").select("source")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[2]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(*_mix(spark, d))


def _model(spark: SparkSession, d: str) -> reading.ReadingModel:
    return reading.train(table(spark, d, "documents"), table(spark, d, "reading_marks"), settle=settle)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.demanding(p9_levels(spark, d))


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(table(spark, d, "documents"), _model(spark, d))


def p9_accuracy(spark: SparkSession, d: str) -> DataFrame:
    rows = [(name, share, n) for name, (share, n) in _model(spark, d).held_out.items()]
    return spark.createDataFrame(rows, "measure string, share double, documents bigint")


QUERIES = {f.__name__: f for f in (
    p1_found, p1_top_values, p2_found, p2_top_identities, p5_found, p5_counts, p5_accuracy,
    p7_found, p7_containers, p7_fill, p8_found, p8_mix, p8_shares, p9_found, p9_levels, p9_accuracy,
)}

_V = f"upper({sql_strip('aa_value')})"
_P1 = f"""
with r as (select distinct id, {_V} as v, weight from composition_records where sample_record = 1 and aa_valid = 1 and weight > 0),
     s as (select v, cast(sum(weight) as bigint) as w, cast(count(*) as bigint) as n from r where v <> '' group by v)"""
_P2 = """
with r as (select distinct id, group_id, identity_key, weight from composition_records where sample_record = 1 and weight > 0),
     s as (select group_id, identity_key, cast(sum(weight) as bigint) as w from r group by all),
     t as (select *, cast(row_number() over (partition by group_id order by w desc, identity_key) as int) as rank from s)"""

ORACLE = {
    "p1_found": _P1 + " select v as aa_value from s where w * 100 >= (select sum(w) from s)",
    "p1_top_values": _P1 + """ select cast(row_number() over (order by w desc, v) as int) as rank, v as aa_value,
        w as total_weight, n as n_rows from s order by w desc, v limit 1000""",
    "p2_found": _P2 + " select group_id, identity_key from t where rank <= 10",
    "p2_top_identities": _P2 + " select group_id, identity_key, w as total_weight, rank from t where rank <= 10",
    "p5_found": f"""
with r as (select distinct id, group_id, coalesce(primer, '') as primer, {_V} as v from composition_records),
     s as (select group_id, primer, count(*) as n, count(distinct v) as k from r where v <> '' group by all)
select group_id, primer from s where n >= 20 and 5 * k < 2 * n""",
    "p5_accuracy": f"""
with r as (select distinct id, strftime(coalesce(created_at, loaded_at), '%Y-%m-%d') as day, group_id, coalesce(primer, '') as primer, {_V} as v from composition_records),
     g as ({" union all ".join(f"select '{','.join(g)}' as grouping, count(distinct v) as k from r where v <> '' group by {', '.join(g) if g else '()'}" for g in bitmaps.groupings(_DIMS))})
select grouping, count(*) as n_sets, cast(sum(k) as bigint) as n_distinct, cast(0 as bigint) as n_outside from g group by 1""",
}
