"""Views that show the driver's tables in the roles the operators expect, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vdjloom.functions.text import sql_strip
from vdjloom.sources.tables import table

PRIMERS = [  # (name, sequence, group): short, so that random reads start with some of them
    ("pA1", "ACGN", "gA"), ("pA2", "TTR", "gA"), ("pA3", "GGCC", "gA"), ("pB1", "ACK", "gB"), ("pB2", "CAYR", "gB"),
    ("pB3", "GCAC", "gB"), ("pC1", "TAS", "gC"), ("pC2", "GAW", "gC"), ("pC3", "CCN", "gC"),
]
_IUPAC = {"R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "N": "ACGT"}


def airr(spark: SparkSession, d: str) -> DataFrame:
    """AIRR rows with copies, scores and a cell barcode, from lineitem, part and orders. part is read as a
    dimension, orders by its key; Spark picks the joins."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_linestatus")
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_name")
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    j = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.selectExpr(
        "o_orderstatus as sample",
        "case l_linenumber when 1 then 'IGH' when 2 then 'IGK' when 3 then 'IGL' when 4 then 'TRA' when 5 then 'TRB' when 6 then 'TRD' else 'TRG' end as locus",
        "case when l_linestatus = 'O' then 'T' else 'F' end as productive",
        "case when p_size % 7 = 0 then concat(p_brand, '*01,', p_type, '*02') else concat(p_brand, '*01') end as v_call", "p_type as j_call",
        "case when p_size % 11 = 0 then null else concat('IGH', substr('MDAGE', cast(1 + p_size % 5 as int), 1)) end as c_call",
        "case when p_size % 13 = 0 then null else upper(replace(p_name, ' ', '')) end as cdr3_aa", "cast(l_quantity as bigint) as umi_counts",
        "l_extendedprice / 100 as v_score", "100 - 100 * l_discount as v_identity", "concat(p_name, '-', cast(l_suppkey as string)) as sequence", "l_orderkey as barcode",
        "l_partkey * 100000 + l_suppkey * 10 + l_linenumber as ordinal",
    )


AIRR_SQL = """airr as (select o_orderstatus as sample,
  case l_linenumber when 1 then 'IGH' when 2 then 'IGK' when 3 then 'IGL' when 4 then 'TRA' when 5 then 'TRB' when 6 then 'TRD' else 'TRG' end as locus,
  case when l_linestatus = 'O' then 'T' else 'F' end as productive,
  case when p_size % 7 = 0 then concat(p_brand, '*01,', p_type, '*02') else concat(p_brand, '*01') end as v_call, p_type as j_call,
  case when p_size % 11 = 0 then null else concat('IGH', substr('MDAGE', cast(1 + p_size % 5 as int), 1)) end as c_call,
  case when p_size % 13 = 0 then null else upper(replace(p_name, ' ', '')) end as cdr3_aa, cast(l_quantity as bigint) as umi_counts,
  l_extendedprice / 100 as v_score, 100 - 100 * l_discount as v_identity, concat(p_name, '-', cast(l_suppkey as varchar)) as sequence, l_orderkey as barcode,
  l_partkey * 100000 + l_suppkey * 10 + l_linenumber as ordinal
  from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey)"""


def umi_reads(spark: SparkSession, d: str) -> DataFrame:
    """Reads with barcode, UMI, sequence and (partly missing) quality, from events."""
    return table(spark, d, "events").selectExpr(
        "user_id as barcode", r"regexp_extract(props, '([0-9]+)', 1) as umi", "upper(event_type) as sequence", "cast(event_id as string) as header",
        "case when event_id % 3 <> 0 then cast(floor(value * 100) as double) end as mean_quality", "case when event_id % 3 <> 0 then cast(floor(value * 10) % 7 as double) end as expected_errors", "event_id as ordinal",
    )


UMI_SQL = r"""reads as (select user_id as barcode, regexp_extract(props, '([0-9]+)', 1) as umi, upper(event_type) as sequence, cast(event_id as varchar) as header,
  case when event_id % 3 <> 0 then cast(floor(value * 100) as double) end as mean_quality, case when event_id % 3 <> 0 then cast(floor(value * 10) % 7 as double) end as expected_errors, event_id as ordinal from events),
counts as (select barcode, umi, sequence, count(*) as n, avg(mean_quality) as mean_quality, avg(expected_errors) as expected_errors, min(header) as header, min(ordinal) as first_ordinal from reads group by 1, 2, 3)"""


PLANTED = tuple(range(15, 136, 20))  # places of the planted substitutions


def hypermutated(spark: SparkSession, d: str) -> DataFrame:
    """Alignments of 160 to 290 columns from observations: the germline is the sequence, its reverse complement and the sequence again; the
    read has substitutions at the first places of PLANTED (as many as its trim length tells), a gap of three for multiple
    matches, and the germline one of two for unmatched ones. What is planted is the best alignment: the changes lie
    too far apart for any other to pay. The V span is the first 60 columns; the copies are the trim length and one."""
    o = table(spark, d, "observations").filter("sequence <> ''").select("id", "sample", F.col("chain").alias("locus"), "c_call", F.upper("sequence").alias("s"), "match_class", "trim_length").distinct()
    base = F.concat("s", F.reverse(F.translate("s", "ACGT", "TGCA")), "s")
    o = o.select("*", base.alias("germline_alignment"), (F.coalesce("trim_length", F.lit(0)) % (len(PLANTED) + 1)).alias("planted"), (F.coalesce("trim_length", F.lit(0)) + 1).cast("bigint").alias("umi_counts"))
    changed = lambda text, p: F.overlay(text, F.translate(text.substr(p, F.lit(1)), "ACGTN", "CATGA"), p)
    read = F.aggregate(F.slice(F.array(*(F.lit(p) for p in PLANTED)), F.lit(1), F.col("planted")), F.col("germline_alignment"), changed)
    read = F.when(F.col("match_class") == "multiple", F.overlay(read, F.lit("---"), F.lit(25))).otherwise(read)
    germline = F.when(F.col("match_class") == "unmatched", F.overlay(F.col("germline_alignment"), F.lit("--"), F.lit(45))).otherwise(F.col("germline_alignment"))
    return o.select("id", "sample", "locus", "c_call", "umi_counts", read.alias("sequence_alignment"), germline.alias("germline_alignment"), F.lit(1).alias("v_alignment_start"), F.lit(60).alias("v_alignment_end"))


HYPERMUTATED_SQL = f"""planted as (select distinct id, sample, chain as locus, c_call, upper(sequence) as s, match_class, trim_length from observations where sequence <> ''),
shm as (select id, sample, locus, c_call, cast(coalesce(trim_length, 0) + 1 as bigint) as w, v, t, cast(v as double) / 60 as vr, cast(t as double) / l as tr from (select *, 3 * length(s) as l,
  case when ig then least(k, {sum(p <= 60 for p in PLANTED)}) + gaps end as v, case when ig then k + gaps end as t from (select *, coalesce(locus in ('IGH', 'IGK', 'IGL'), false) as ig, coalesce(trim_length, 0) % {len(PLANTED) + 1} as k, case match_class when 'multiple' then 3 when 'unmatched' then 2 else 0 end as gaps from planted)))"""


def records(spark: SparkSession, d: str) -> DataFrame:
    """Composition records, each once; repeated deliveries are equal but for loaded_at."""
    cols = ["id", "group_id", "primer", "sample_record", "weight", "eligible", "aa_field", "aa_value", "aa_valid", "isotype_main", "isotype_state", "identity_key"]
    return table(spark, d, "composition_records").select(*cols).distinct()


def calls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "composition_calls").select("record_id", "segment", "gene", "assignment").distinct()


RECORDS_SQL = """records as (select distinct id, group_id, primer, sample_record, weight, eligible, aa_field, aa_value, aa_valid, isotype_main, isotype_state, identity_key from composition_records),
calls as (select distinct record_id, segment, gene, assignment from composition_calls)"""


def observations(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Observations, each id once."""
    return table(spark, d, "observations").select("id", *cols).distinct()


def obs_sql(*cols: str) -> str:
    return f"obs as (select distinct id, {', '.join(cols)} from observations)"


def sql_pattern(seq: str) -> str:
    return "^" + "".join(f"[{_IUPAC.get(b, b)}]" for b in seq)


PRIMER_SQL = "primers as (select * from (values " + ", ".join(f"('{n}', '{s}', '{g}', '{sql_pattern(s)}')" for n, s, g in PRIMERS) + ") t(name, family, grp, pattern))"
MATCH_SQL = f"""{obs_sql('sample_key', 'chain', 'sequence', 'filter_reason', 'v_call')}, {PRIMER_SQL},
hits as (select id, list_sort(list_distinct(list(name))) as names, list_sort(list_distinct(list(family))) as families from obs join primers on regexp_matches(upper(sequence), pattern) group by id),
cat as (select o.*, coalesce(names, cast([] as varchar[])) as names, coalesce(families, cast([] as varchar[])) as families,
  case when coalesce(length(sequence), 0) = 0 then 'sequence_unavailable' when len(names) = 1 then 'unique' when len(names) > 1 then 'multiple' else 'unmatched' end as match_class
  from obs o left join hits using (id))"""
STRIP = sql_strip
