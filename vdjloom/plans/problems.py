"""The pN queries of the core's operators, with production parameters on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vdjloom.functions.text import reference_key, sql_reference_key
from vdjloom.operators import eager, packed, references
from vdjloom.plans.durable import settle
from vdjloom.sources.tables import table

_REF_KEY = {"composition_calls": "k", "observations": "k", "derived_runs": "k"}


def _references(spark: SparkSession, d: str, write=None) -> dict[str, tuple[DataFrame, DataFrame]]:
    """By referring table: its references, and those without a target (with write: their numbers, too)."""
    at = F.col("loaded_at").alias("at")

    def refs(name: str, col: str, *more: str) -> DataFrame:
        r = table(spark, d, name).select(reference_key(col).alias("k"), *(reference_key(m).alias(m) for m in more), at)
        return r.filter(F.col("k").isNotNull())

    def live(name: str, col: str, *more: str) -> DataFrame:
        t = table(spark, d, name)
        t = t.filter("deleted_at is null") if "deleted_at" in t.columns else t
        return t.select(reference_key(col).alias("k"), *(reference_key(m).alias(m) for m in more), at).filter(F.col("k").isNotNull())

    calls, obs, runs = refs("composition_calls", "record_id"), refs("observations", "mapping_sequence_id", "sample_key", "chain"), refs("derived_runs", "parent_job_id")
    return {
        "composition_calls": (calls, references.orphans(calls, live("composition_records", "id"), ["k"], write)),
        "observations": (obs, references.orphans(obs, live("annotations", "sequence_id", "sample_key", "chain"), ["k", "sample_key", "chain"], write)),
        "derived_runs": (runs, references.orphans(runs, live("jobs", "id"), ["k"], write)),
    }


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, (_, lost) in _references(spark, d).items():
        one = lost.select(F.lit(name).alias("table_name"), F.col("k").alias("ref_key"), "load_month").distinct()
        out = one if out is None else out.unionByName(one)
    return out


def p3_orphans_by_month(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_report(_references(spark, d, settle), _REF_KEY)


def _per_sample(spark: SparkSession, d: str) -> DataFrame:
    """Observations joined with the live annotations of their sample, per sample."""
    obs = table(spark, d, "observations")
    notes = table(spark, d, "annotations").filter("deleted_at is null")
    s = eager.eager_join(obs, notes, F.col("sample_key"), F.col("sample_key"), {"trim_length_sum": F.col("trim_length").cast("bigint")}, {"productive": (F.col("productive") == "T").cast("bigint")})
    return eager.share_of_rows(s, obs)


def _per_identity(spark: SparkSession, d: str) -> DataFrame:
    """Composition records joined with their gene calls, per identity: the states meet by
    record, then are rolled up to identities."""
    rec = table(spark, d, "composition_records")
    calls = table(spark, d, "composition_calls")
    by_record = eager.eager_join(rec, calls, F.col("id"), F.col("record_id"), {"weight_sum": F.col("weight")}, {"ambiguous_calls": (F.col("assignment") == "ambiguous").cast("bigint")}, carry=["identity_key"])
    s = eager.roll_up(by_record, ["identity_key"], ["n_left", "joined_rows", "weight_sum", "joined_weight_sum", "joined_ambiguous_calls"])
    return eager.share_of_rows(s.withColumnRenamed("identity_key", "key_value"), rec)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    # names the heavy keys of the per-key results, which are written whole; only their left counts decide
    one = eager.heavy(settle(_per_sample(spark, d))).select(F.lit("sample_key").alias("field_name"), "key_value")
    return one.unionByName(eager.heavy(settle(_per_identity(spark, d))).select(F.lit("identity_key").alias("field_name"), "key_value"))


def p4_per_sample(spark: SparkSession, d: str) -> DataFrame:
    s = _per_sample(spark, d)
    return s.select(F.col("key_value").alias("sample_key"), F.col("n_left").alias("observations"), F.col("n_right").alias("annotations"), F.col("joined_rows").cast("bigint").alias("joined_rows"), F.col("joined_trim_length_sum").cast("bigint").alias("joined_trim_length"), F.col("joined_productive").cast("bigint").alias("joined_productive"))


def p4_per_identity(spark: SparkSession, d: str) -> DataFrame:
    s = _per_identity(spark, d)
    return s.select(F.col("key_value").alias("identity_key"), F.col("n_left").alias("records"), F.col("joined_rows").cast("bigint").alias("joined_rows"), "weight_sum", F.col("joined_weight_sum").cast("bigint").alias("joined_weight"), F.col("joined_ambiguous_calls").cast("bigint").alias("joined_ambiguous"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return packed.split_packed(table(spark, d, "observations"), "id", ["primers", "v_call", "j_call"], settle)


def p6_known(spark: SparkSession, d: str) -> DataFrame:
    """Lists whose items are known: three names of each customer, one with a comma in it, written in a way of the customer's
    segment: as JSON, as JSON within JSON, with semicolons, with quotes and commas, with tabs. Only the JSON tells the names apart for certain."""
    items = F.array("c_name", F.concat(F.lit("IgL,w"), F.col("c_nationkey") % 4), F.concat(F.lit("R_"), "c_nationkey"))
    c = table(spark, d, "customer").withColumn("i", items).withColumn("j", F.to_json("i"))
    way = {"AUTOMOBILE": F.col("j"), "BUILDING": F.concat(F.lit('"'), F.replace("j", F.lit('"'), F.lit('\\"')), F.lit('"')), "FURNITURE": F.array_join("i", "; "), "MACHINERY": F.concat(F.lit('"'), F.array_join("i", '","'), F.lit('"'))}
    packed_ = F.array_join("i", "\t")
    for segment, text in way.items():
        packed_ = F.when(F.col("c_mktsegment") == segment, text).otherwise(packed_)
    return packed.split_packed(c.select(F.col("c_custkey").alias("id"), packed_.alias("primers")), "id", ["primers"], settle)


QUERIES = {f.__name__: f for f in (p3_found, p3_orphans_by_month, p4_found, p4_per_sample, p4_per_identity, p6_found, p6_known)}

_LOST = f"""
with refs as (
  select 'composition_calls' as t, {sql_reference_key('record_id')} as k, '' as a, '' as b, loaded_at as at from composition_calls
  union all select 'observations', {sql_reference_key('mapping_sequence_id')}, {sql_reference_key('sample_key')}, {sql_reference_key('chain')}, loaded_at from observations
  union all select 'derived_runs', {sql_reference_key('parent_job_id')}, '', '', loaded_at from derived_runs),
targets as (
  select 'composition_calls' as t, {sql_reference_key('id')} as k, '' as a, '' as b, min(loaded_at) as first from composition_records group by 1, 2
  union all select 'observations', {sql_reference_key('sequence_id')}, {sql_reference_key('sample_key')}, {sql_reference_key('chain')}, min(loaded_at) from annotations where deleted_at is null group by 1, 2, 3, 4
  union all select 'derived_runs', {sql_reference_key('id')}, '', '', min(loaded_at) from jobs where deleted_at is null group by 1, 2),
named as (select r.*, strftime(r.at, '%Y-%m') as m, (g.first is null or g.first > r.at) as lost
  from refs r left join targets g on r.t = g.t and r.k = g.k and r.a = g.a and r.b = g.b where r.k is not null)"""

ORACLE = {
    "p3_found": _LOST + " select distinct t as table_name, k as ref_key, m as load_month from named where lost",
    "p3_orphans_by_month": _LOST + """ select t as table_name, m as load_month, count(*) as n_references,
        count(distinct k) filter (where lost) as orphan_keys, count(*) filter (where lost) as orphan_rows from named group by 1, 2""",
    "p4_found": """
select 'sample_key' as field_name, sample_key as key_value from observations where sample_key is not null group by 2
  having count(*) * 50 >= (select count(*) from observations)
union all select 'identity_key', identity_key from composition_records where identity_key is not null group by 2
  having count(*) * 50 >= (select count(*) from composition_records)""",
    "p4_per_sample": """
with o as (select sample_key, count(*) as n, sum(trim_length) as t from observations group by 1),
     a as (select sample_key as k, count(*) as n, sum(case when productive = 'T' then 1 when productive is not null then 0 end) as p
           from annotations where deleted_at is null group by 1)
select sample_key, o.n as observations, coalesce(a.n, 0) as annotations, cast(o.n * coalesce(a.n, 0) as bigint) as joined_rows,
  cast(o.t * coalesce(a.n, 0) as bigint) as joined_trim_length, cast(a.p * o.n as bigint) as joined_productive
from o left join a on o.sample_key = a.k""",
    "p4_per_identity": """
with c as (select record_id as k, count(*) as n, sum(case when assignment = 'ambiguous' then 1 when assignment is not null then 0 end) as a
           from composition_calls group by 1)
select identity_key, count(*) as records, cast(sum(coalesce(n, 0)) as bigint) as joined_rows, cast(sum(weight) as bigint) as weight_sum,
  cast(sum(weight * coalesce(n, 0)) as bigint) as joined_weight, cast(sum(a) as bigint) as joined_ambiguous
from composition_records left join c on id = k group by 1""",
    "p6_known": """
select c_custkey as id, 'primers' as field_name, cast(p as int) as pos, case p when 1 then c_name when 2 then 'IgL,w' || (c_nationkey % 4) else 'R_' || c_nationkey end as item
from customer, (select unnest([1, 2, 3]) as p)""",
}
