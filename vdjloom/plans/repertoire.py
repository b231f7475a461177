"""Queries of the repertoire operators over AIRR rows, reads and cells, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vdjloom.functions import calls as C
from vdjloom.functions import headers as H
from vdjloom.operators import bcell, cells, clones, diversity, filters, ranking, umi
from vdjloom.plans import roles
from vdjloom.plans.durable import settle
from vdjloom.plans.roles import AIRR_SQL, HYPERMUTATED_SQL, UMI_SQL
from vdjloom.sources import sinks
from vdjloom.sources.tables import table

S = SparkSession
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as two engines add in different orders; a negative zero becomes zero."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# --- clones ---------------------------------------------------------------------------------

_CLONES = f"""with {AIRR_SQL}, c as (select sample, locus as chain, v_call, j_call, cdr3_aa, count(*) as record_count
  from airr where productive = 'T' and trim(cdr3_aa) <> '' group by all)"""


def _clones(s: S, d: str) -> DataFrame:
    return clones.clone_counts(roles.airr(s, d).withColumnRenamed("locus", "chain"), ["sample", "chain"])


@query(_CLONES + """ select sample, chain, cast(row_number() over w as bigint) as rank, v_call, j_call, cdr3_aa, record_count,
  round(cast(100 as double) * record_count / sum(record_count) over p, 6) as frequency_percent,
  round(cast(100 as double) * sum(record_count) over (w rows unbounded preceding) / sum(record_count) over p, 6) as cumulative_frequency_percent
  from c window p as (partition by sample, chain), w as (partition by sample, chain order by record_count desc, v_call, j_call, cdr3_aa)""")
def clone_top(s: S, d: str) -> DataFrame:
    """A31, R14, F07"""
    return rounded(clones.clone_top(_clones(s, d), ["sample", "chain"]))


@query(_CLONES + " select sample, chain, count(*) as clones, cast(sum(record_count) as bigint) as records, cast(max(record_count) as bigint) as largest from c group by 1, 2")
def clone_total_by_chain(s: S, d: str) -> DataFrame:
    """A31"""
    return _clones(s, d).groupBy("sample", "chain").agg(F.count(F.lit(1)).alias("clones"), F.sum("record_count").alias("records"), F.max("record_count").alias("largest"))


@query()
def treemap_layout(s: S, d: str) -> DataFrame:
    """L08"""
    return rounded(clones.treemap_layout(clones.clone_top(_clones(s, d), ["sample", "chain"]), ["sample", "chain"], settle=settle), 3)


@query(_CLONES + f""", t as (select sample, chain, cast(row_number() over w as bigint) as rank, v_call, j_call, cdr3_aa, record_count from c window w as (partition by sample, chain order by record_count desc, v_call, j_call, cdr3_aa))
  select t.sample, t.chain, rank, record_count as records_of_area, cast((cast('0x' || left(md5(t.v_call || '|' || t.j_call || '|' || cdr3_aa), 12) as bigint) + {clones.FIRST_COLOUR}) % {clones.COLOURS} as int) as colour, true as within from t""")
def treemap_areas(s: S, d: str) -> DataFrame:
    """The area and colour of every clone's rectangle, which lies within the picture"""
    c = settle(_clones(s, d))
    t = clones.treemap_layout(clones.clone_top(c, ["sample", "chain"]), ["sample", "chain"], settle=settle)
    total = c.groupBy("sample", "chain").agg(F.sum("record_count").alias("_total"))
    low, high = -1e-6, 100 + 1e-6
    within = (F.col("x") >= low) & (F.col("y") >= low) & (F.col("x") + F.col("w") <= high) & (F.col("y") + F.col("h") <= high)
    of_area = F.round(F.col("w") * F.col("h") * F.col("_total") / 10000).cast("bigint")
    return t.join(total, ["sample", "chain"]).select("sample", "chain", "rank", of_area.alias("records_of_area"), "colour", within.alias("within"))


@query(_CLONES + """ select sample, chain, cast(row_number() over w as bigint) as rank, v_call, j_call, cdr3_aa, record_count, printf('%.8f', cast(100 as double) * record_count / sum(record_count) over p) as frequency_percent
  from c window p as (partition by sample, chain), w as (partition by sample, chain order by record_count desc, v_call, j_call, cdr3_aa)""")
def clone_export(s: S, d: str) -> DataFrame:
    """K07"""
    return sinks.clone_export(clones.clone_top(_clones(s, d), ["sample", "chain"]), ["sample", "chain"]).drop("cumulative_frequency_percent")


# --- filters --------------------------------------------------------------------------------

_F = "locus is not null and productive = 'T' and v_score > 150 and v_identity > 85 and (v_call is not null or j_call is not null)"


@query(f"""with {AIRR_SQL}, f as (select sample, locus, productive, v_call, j_call, c_call, cdr3_aa, v_score, v_identity, sequence, count(*) over (partition by sample, sequence) as umi_counts from airr where {_F}),
  g as (select distinct * from f), t as (select *, avg(case when contains(locus, 'TR') then 1.0 else 0.0 end) over (partition by sample) as tr from g)
  select sample, locus, productive, v_call, j_call, c_call, cdr3_aa, round(v_score, 6) as v_score, round(v_identity, 6) as v_identity, sequence, umi_counts from t where tr <= 0.9 or v_identity >= 99.7""")
def airr_filter_umi_counts(s: S, d: str) -> DataFrame:
    """F01, F02, A01"""
    return rounded(filters.airr_filter(roles.airr(s, d).drop("barcode", "ordinal", "umi_counts"), ["sample"]))


@query("""with a as (select distinct ordinal, sample_key, chain, locus, v_call, productive from annotations), r as (select sample_key, chain,
  case when v_call is null or upper(trim(v_call)) in ('', '*', '-', 'NA', 'N/A', 'NONE', 'NULL', 'NO_HIT', 'UNMAPPED', 'NOT_FOUND') then 'no_v_call'
  when upper(trim(coalesce(productive, ''))) not in ('T', 'TRUE') then 'nonproductive_or_unknown' when upper(trim(coalesce(locus, ''))) not in ('IGH','IGK','IGL','TRA','TRB','TRD','TRG') then 'unknown_locus'
  when upper(trim(locus)) <> upper(trim(chain)) then 'different_locus' else 'retained' end as reason from a)
  select sample_key, chain, reason, count(*) as n from r group by all""")
def mapping_filter_reasons(s: S, d: str) -> DataFrame:
    """F03"""
    a = table(s, d, "annotations").select("ordinal", "sample_key", "chain", "locus", "v_call", "productive").distinct()
    return a.withColumn("reason", filters.mapping_reason("chain")).groupBy("sample_key", "chain", "reason").agg(F.count(F.lit(1)).alias("n"))


_V_OK = "(v_call is not null and upper(trim(v_call)) not in ('', '*', '-', 'NA', 'N/A', 'NONE', 'NULL', 'NO_HIT', 'UNMAPPED', 'NOT_FOUND'))"
_P_OK = "coalesce(upper(trim(productive)) in ('T', 'TRUE'), false)"
_L_OK = "coalesce(upper(trim(locus)), '') in ('IGH','IGK','IGL','TRA','TRB','TRD','TRG')"


@query(f"""with a as (select distinct ordinal, sample_key, chain, locus, v_call, productive from annotations)
  select sample_key, chain, count(*) as raw_rows, count(*) filter (where {_V_OK}) as mapped_rows, count(*) filter (where {_P_OK}) as productive_rows,
  count(*) filter (where {_V_OK} and {_P_OK} and coalesce(upper(trim(locus)) = chain, false)) as output_rows, count(*) filter (where {_V_OK} and {_P_OK}) as locus_input_rows,
  count(*) filter (where {_V_OK} and {_P_OK} and not coalesce(upper(trim(locus)) = chain, false)) as excluded_locus_rows, count(*) filter (where {_V_OK} and {_P_OK} and not {_L_OK}) as unknown_locus_rows
  from a group by 1, 2""")
def locus_split_report(s: S, d: str) -> DataFrame:
    """F03, F06"""
    a = table(s, d, "annotations").select("ordinal", "sample_key", "chain", "locus", "v_call", "productive").distinct()
    return filters.mapping_report(a, ["sample_key", "chain"], "chain")


@query(f"with a as (select distinct ordinal, sample_key, locus, v_call, productive from annotations) select sample_key, count(*) as rows_kept from a where {_V_OK} and {_P_OK} group by 1")
def remapping_filter(s: S, d: str) -> DataFrame:
    """F04"""
    a = table(s, d, "annotations").select("ordinal", "sample_key", "locus", "v_call", "productive").distinct()
    return filters.remapping_filter(a).groupBy("sample_key").agg(F.count(F.lit(1)).alias("rows_kept"))


@query(f"""with {AIRR_SQL}, f as (select * from airr where sequence <> '' and umi_counts > 0 and productive = 'T' and v_score > 150 and v_identity > 85),
  t as (select *, avg(case when contains(locus, 'TR') then 1.0 else 0.0 end) over (partition by sample) as tr from f)
  select sample, locus, count(*) as n, cast(sum(umi_counts) as bigint) as umi_counts from t where tr <= 0.9 or v_identity >= 99.7 group by 1, 2""")
def tenx_filter(s: S, d: str) -> DataFrame:
    """F05"""
    a = roles.airr(s, d).withColumn("barcode", F.col("barcode").cast("string"))
    return filters.droplet_filter(a, ["sample"]).groupBy("sample", "locus").agg(F.count(F.lit(1)).alias("n"), F.sum("umi_counts").alias("umi_counts"))


@query(f"with {AIRR_SQL} select sample, case when starts_with(locus, 'TR') then 'TCR' else 'BCR' end as receptor, count(*) as n, cast(sum(umi_counts) as bigint) as umi_counts from airr group by 1, 2")
def receptor_partition(s: S, d: str) -> DataFrame:
    """K15"""
    return roles.airr(s, d).groupBy("sample", sinks.receptor("locus").alias("receptor")).agg(F.count(F.lit(1)).alias("n"), F.sum("umi_counts").alias("umi_counts"))


# --- expression and diversity ---------------------------------------------------------------


@query(f"""with {AIRR_SQL}, g as (select sample, locus, sum(umi_counts) as u, count(distinct cdr3_aa) as k from airr group by 1, 2)
  select sample, locus, cast(u as bigint) as umi_counts, k as unique_cdr3, round(cast(u as double) / sum(u) over (partition by sample), 6) as share from g""")
def expression_by_locus(s: S, d: str) -> DataFrame:
    """A02"""
    return rounded(diversity.expression(roles.airr(s, d), ["sample"]))


_IGH = f"with {AIRR_SQL}, h as (select * from airr where locus = 'IGH' and c_call is not null)"


@query(_IGH + """, g as (select sample, c_call as gene, sum(umi_counts) as u from h where cdr3_aa is not null group by 1, 2)
  select sample, gene, cast(u as bigint) as umi_counts, round(cast(u as double) / sum(u) over (partition by sample), 6) as ratio from g""")
def isotype_ratio(s: S, d: str) -> DataFrame:
    """A03, F13"""
    return rounded(bcell.isotype_ratio(roles.airr(s, d), ["sample"]))


def _diversity_sql(source: str, key: str) -> str:
    return f"""{source}, t as (select {key}, umi_counts as w, cdr3_aa, sum(umi_counts) over p as tot, count(*) over p as n,
    sum(umi_counts) over (p order by umi_counts desc rows unbounded preceding) as down, sum(umi_counts) over (p order by umi_counts rows unbounded preceding) as up from x window p as (partition by {key})),
  c as (select {key}, max(u) / cast(sum(u) as double) as largest from (select {key}, cdr3_aa, sum(umi_counts) as u from x where cdr3_aa is not null group by all) group by all)
  select {key}, any_value(n) as n_rows, cast(any_value(tot) as bigint) as total, round(100.0 * count(*) filter (where 2 * down <= tot) / any_value(n), 6) as "D50", round(any_value(largest), 6) as "Largest_clone_percent",
  round(-sum((w / cast(tot as double)) * ln(w / cast(tot as double))), 6) + 0.0 as "Shannon_index", case when any_value(n) > 1 then round(-sum((w / cast(tot as double)) * ln(w / cast(tot as double))) / ln(any_value(n)), 6) end as "Pielou_evenness",
  round(greatest(0.0, 1 - 2 * sum(up / cast(tot as double)) / any_value(n)), 6) as "Gini_index", round(1 - sum((w / cast(tot as double)) * (w / cast(tot as double))), 6) as "Simpson_index",
  round(1 / sum((w / cast(tot as double)) * (w / cast(tot as double))) / any_value(n), 6) as "Simpson_evenness" from t left join c using ({key}) group by {key}"""


_DIV = _diversity_sql(f"with {AIRR_SQL}, x as (select sample, locus, umi_counts, cdr3_aa from airr)", "sample, locus")


def _diversity(s: S, d: str) -> DataFrame:
    return diversity.diversity(roles.airr(s, d), ["sample", "locus"])


@query(_DIV)
def diversity_all(s: S, d: str) -> DataFrame:
    """D01-D07, A04"""
    return rounded(_diversity(s, d))


def _one_metric(name: str, metric: str) -> None:
    def run(s: S, d: str) -> DataFrame:
        return rounded(_diversity(s, d).select("sample", "locus", metric))

    run.__name__ = name
    query(f'select sample, locus, "{metric}" from ({_DIV})')(run)


for _n, _m in zip(("d50", "largest_clone", "shannon", "pielou", "gini", "simpson", "simpson_evenness"), diversity.METRICS):
    _one_metric(f"diversity_{_n}", _m)


@query(_diversity_sql(_IGH + ", x as (select sample, c_call as gene, umi_counts, cdr3_aa from h where cdr3_aa is not null)", "sample, gene"))
def bcell_diversity(s: S, d: str) -> DataFrame:
    """A05"""
    a = roles.airr(s, d).filter("locus = 'IGH' and cdr3_aa is not null").withColumn("gene", C.unique_gene("c_call"))
    return rounded(diversity.diversity(a.filter("gene like '%IGH%'"), ["sample", "gene"]))


@query(f"""with v as ({_DIV}) unpivot v on "D50", "Largest_clone_percent", "Shannon_index", "Pielou_evenness", "Gini_index", "Simpson_index", "Simpson_evenness" into name metric value value""".replace("with v as (", "select sample, locus, metric, value from (unpivot (").replace(") unpivot v on", ") on") + ")")
def datapoint_long(s: S, d: str) -> DataFrame:
    """A40, D08; null values are left out"""
    return rounded(diversity.long_metrics(_diversity(s, d), ["sample", "locus"]).filter("value is not null"))


@query(f"select sample, max(case when locus = 'IGH' then \"D50\" end) as \"IGH_D50\", max(case when locus = 'IGH' then \"Shannon_index\" end) as \"IGH_Shannon_index\", max(case when locus = 'TRB' then \"D50\" end) as \"TRB_D50\" from ({_DIV}) group by 1")
def datapoint_wide(s: S, d: str) -> DataFrame:
    """A40, K05"""
    long = diversity.long_metrics(_diversity(s, d), ["sample", "locus"])
    named = long.select("sample", F.concat_ws("_", "locus", "metric").alias("metric"), "value")
    return rounded(diversity.wide_metrics(named, ["sample"], ["IGH_D50", "IGH_Shannon_index", "TRB_D50"]))


@query(f"""select sample, locus, metric, round(case when metric = 'Largest_clone_percent' then value * 100 else value end, 3) as value, case when metric in ('D50', 'Largest_clone_percent') then '%' else 'index' end as unit, 'complete' as status
  from (select sample, locus, unnest(['D50', 'Largest_clone_percent', 'Simpson_index']) as metric, unnest(["D50", "Largest_clone_percent", "Simpson_index"]) as value from ({_DIV})) where value is not null""")
def report_metrics(s: S, d: str) -> DataFrame:
    """D08"""
    long = diversity.long_metrics(_diversity(s, d), ["sample", "locus"], ("D50", "Largest_clone_percent", "Simpson_index"))
    return rounded(diversity.report_metrics(rounded(long)).filter("status = 'complete'"), 3)


@query(_IGH + """ select sample, round(sum(case when c_call in ('IGHD', 'IGHM') then umi_counts else 0 end) / cast(sum(umi_counts) as double), 6) as unswitched,
  round(1 - sum(case when c_call in ('IGHD', 'IGHM') then umi_counts else 0 end) / cast(sum(umi_counts) as double), 6) as switched from h group by 1""")
def csr_switched(s: S, d: str) -> DataFrame:
    """A06"""
    return rounded(bcell.class_switching(roles.airr(s, d), ["sample"]))


@query(_IGH + """, per as (select sample, cdr3_aa, c_call as g, sum(umi_counts) as u from h where cdr3_aa is not null group by all),
  p as (select a.sample, a.g || '-' || b.g || '_CSR_ratio' as csr_name, sum(a.u + b.u) as u from per a join per b on a.sample = b.sample and a.cdr3_aa = b.cdr3_aa and a.g < b.g group by all)
  select sample, csr_name, round(p.u / cast(t.u as double), 6) as ratio from p join (select sample, sum(umi_counts) as u from h group by 1) t using (sample)""")
def csr_pairs(s: S, d: str) -> DataFrame:
    """A07, J14"""
    return rounded(bcell.switch_pairs(roles.airr(s, d), ["sample"]))


# --- gene calls -----------------------------------------------------------------------------

_OC = "with o as (select distinct id, v_call, j_call, c_call from observations)"


@query(_OC + f""", l as (select id, 'V' as segment, {C.sql_calls('v_call')} as g from o union all select id, 'J', {C.sql_calls('j_call')} from o union all select id, 'C', {C.sql_calls('c_call')} from o),
  e as (select segment, case when len(g) = 1 then 'unique' when len(g) > 1 then 'ambiguous' else 'unannotated' end as assignment, unnest(case when len(g) = 0 then [''] else g end) as gene from l)
  select segment, assignment, gene, count(*) as n from e group by all""")
def gene_calls_exploded(s: S, d: str) -> DataFrame:
    """F12, UDTF"""
    o = roles.observations(s, d, "v_call", "j_call", "c_call")
    x = o.select(F.explode(F.array(*(F.struct(F.lit(k).alias("segment"), C.calls(f"{k.lower()}_call").alias("g")) for k in "VJC"))).alias("s")).select("s.*")
    x = x.withColumn("assignment", C.assignment(F.col("g"))).withColumn("gene", F.explode(F.when(F.size("g") == 0, F.array(F.lit(""))).otherwise(F.col("g"))))
    return x.groupBy("segment", "assignment", "gene").agg(F.count(F.lit(1)).alias("n"))


@query(_OC + f" select id, array_to_string({C.sql_calls('v_call')}, '|') as v_genes, {C.sql_unique_gene('c_call')} as c_gene from o")
def gene_call_assignment(s: S, d: str) -> DataFrame:
    """F12, F13"""
    return roles.observations(s, d, "v_call", "j_call", "c_call").select("id", F.array_join(C.calls("v_call"), "|").alias("v_genes"), C.unique_gene("c_call").alias("c_gene"))


@query(_OC + f" select id, coalesce(array_to_string({C.sql_names('upper(trim(v_call))', '[,;|]')}, '|'), '') as v_key from o where v_call is not null")
def normal_gene(s: S, d: str) -> DataFrame:
    """F14"""
    return roles.observations(s, d, "v_call", "j_call", "c_call").filter("v_call is not null").select("id", C.normal_gene("v_call").alias("v_key"))


@query("with o as (select distinct id, sequence from observations) select id, coalesce(regexp_replace(upper(sequence), '[\\s.\\-]', '', 'g'), '') as nt from o")
def normal_nt(s: S, d: str) -> DataFrame:
    """F15"""
    return roles.observations(s, d, "sequence").select("id", C.normal_nt("sequence").alias("nt"))


@query("""with g as (select distinct segment, gene from composition_calls where gene is not null), n as (select segment, gene, upper(string_split(gene, '*')[1]) as u from g),
  f as (select *, case segment when 'C' then regexp_extract(u, '^(IGH[AMDEG]|IGKC|IGLC|TR[ABDG]C)', 1) when 'V' then regexp_extract(u, '^((?:IGH|IGK|IGL|TRA|TRB|TRD|TRG)V[0-9]+)', 1)
  when 'J' then coalesce(nullif(regexp_extract(u, '^((?:IGH|IGK|IGL|TRA|TRB|TRD|TRG)J[0-9]+)-', 1), ''), regexp_extract(u, '^((?:IGH|IGK|IGL|TRA|TRB|TRD|TRG)J)', 1)) else '' end as x from n)
  select segment, gene, case when x <> '' then x else u end as family from f""")
def gene_family(s: S, d: str) -> DataFrame:
    """F17"""
    g = table(s, d, "composition_calls").select("segment", "gene").filter("gene is not null").distinct()
    return g.select("segment", "gene", C.gene_family("gene", "segment").alias("family"))


@query("""with o as (select distinct c_call from observations), g as (select c_call, """ + C.sql_calls("c_call") + """ as g from o),
  h as (select c_call, list_transform(g, lambda x: upper(x)) as g from g), i as (select c_call, g, list_distinct(list_transform(g, lambda x: 'Ig' || regexp_extract(x, '^IGH([MDAGE])([0-9]+(-[0-9]+)?)?$', 1))) as m,
  list_distinct(list_transform(g, lambda x: 'Ig' || regexp_extract(x, '^IGH([MDAGE])([0-9]+(-[0-9]+)?)?$', 1) || regexp_extract(x, '^IGH([MDAGE])([0-9]+(-[0-9]+)?)?$', 2))) as t,
  len(list_filter(g, lambda x: not regexp_matches(x, '^IGH([MDAGE])([0-9]+(-[0-9]+)?)?$'))) as odd from h),
  j as (select *, case when len(g) = 0 then 'unannotated' when odd > 0 then 'unclassified' when len(m) = 1 then 'classified' else 'ambiguous' end as state from i)
  select c_call, case when state = 'classified' then m[1] else '' end as isotype_main, case when state = 'classified' and len(t) = 1 then t[1] else '' end as isotype_subclass, state from j""")
def isotype_classify(s: S, d: str) -> DataFrame:
    """F16"""
    return table(s, d, "observations").select("c_call").distinct().withColumn("i", C.isotype("c_call")).select("c_call", F.col("i.main").alias("isotype_main"), F.col("i.subtype").alias("isotype_subclass"), "i.state")


@query("""with t as (select distinct sequence_id from observations where sequence_id is not null), k as (select sequence_id, regexp_replace(string_split(string_split_regex(trim(sequence_id), '\\s+')[1], '#')[1], '/[12]$', '') as t from t),
  f as (select sequence_id, string_split(t, ':') as f from k), g as (select sequence_id, case when len(f) >= 8 then f[1:7] else f end as f from f)
  select sequence_id, array_to_string(list_transform(f, lambda x, i: case when i <= 3 then x else coalesce(nullif(regexp_replace(regexp_replace(x, '[A-Za-z]', '', 'g'), '^0+', ''), ''), '0') end), ':') as canonical from g""")
def canonical_header(s: S, d: str) -> DataFrame:
    """F09"""
    return table(s, d, "observations").select("sequence_id").filter("sequence_id is not null").distinct().withColumn("canonical", H.canonical_header("sequence_id"))


@query("""with g as (select distinct gene from composition_calls where gene is not null and gene <> '')
  select gene, array_to_string(list_transform(regexp_extract_all(upper(gene), '[0-9]+|[^0-9]+'), lambda x: case when regexp_matches(x, '^[0-9]') then lpad(x, 12, '0') else x end), '') as order_key from g""")
def natural_gene_order(s: S, d: str) -> DataFrame:
    """F18"""
    return table(s, d, "composition_calls").select("gene").filter("gene is not null and gene <> ''").distinct().withColumn("order_key", C.natural_order("gene"))


@query("""with g as (select distinct gene from composition_calls where segment = 'C' and gene <> '')
  select gene, case when starts_with(gene, 'IGH') then 'Ig' || substr(gene, 4) else gene end as label, cast(coalesce(nullif(instr('MDAGE', nullif(substr(upper(gene), 4, 1), '')), 0) - 1, 5) as int) as position from g""")
def isotype_labels(s: S, d: str) -> DataFrame:
    """F20, L02"""
    g = table(s, d, "composition_calls").filter("segment = 'C' and gene <> ''").select("gene").distinct()
    return g.select("gene", C.isotype_label("gene").alias("label"), C.isotype_rank("gene").cast("int").alias("position"))


@query("with r as (select distinct aa_value from composition_records) select aa_value, coalesce(regexp_matches(upper(" + roles.STRIP("aa_value") + "), '^[ACDEFGHIKLMNPQRSTVWY]+$'), false) as valid from r")
def aa_validity(s: S, d: str) -> DataFrame:
    """F19"""
    return table(s, d, "composition_records").select("aa_value").distinct().withColumn("valid", C.aa_valid("aa_value"))


# --- UMIs and cells -------------------------------------------------------------------------

_REP = f"""with {UMI_SQL}, m as (select *, max(n) over k as mx, cast(sum(n) over k as bigint) as total, count(*) over k as seqs from counts window k as (partition by barcode, umi)),
  c as (select *, length(sequence) - length(replace(sequence, 'N', '')) as ns, max(case when expected_errors is not null or mean_quality is not null then 1 else 0 end) over (partition by barcode, umi) as q, count(*) over (partition by barcode, umi) as top from m where n = mx),
  r as (select *, rank() over (partition by barcode, umi order by case when q = 1 then case when expected_errors is null then 1 else 0 end end, case when q = 1 then expected_errors end nulls last, case when q = 1 then mean_quality end desc nulls last, ns) as tie from c),
  f as (select *, sum(case when tie = 1 then 1 else 0 end) over (partition by barcode, umi) as ties, row_number() over (partition by barcode, umi order by tie, sequence) as rn from r),
  rep as (select barcode, umi, total as total_reads, n as representative_reads, round(n * 100.0 / total, 2) as percent, seqs as unique_sequences, top as top_candidates,
   case when top = 1 then 'CLEAR' when q = 0 then 'TIED_NO_QUALITY' when ties > 1 then 'TIED_AFTER_QUALITY' else 'RESOLVED_BY_QUALITY' end as ambiguity,
   case when q = 0 then 'COUNT_ONLY_NO_QUALITY' else 'COUNT_THEN_QUALITY' end as selection_method, sequence, header from f where rn = 1)"""


def _representatives(s: S, d: str) -> DataFrame:
    return umi.representatives(umi.sequence_counts(roles.umi_reads(s, d), ["barcode", "umi"]), ["barcode", "umi"])


@query(_REP + " select 'REP_' || substr(sha256(cast(barcode as varchar) || chr(0) || umi), 1, 24) as representative_id, * from rep")
def umi_representative(s: S, d: str) -> DataFrame:
    """R01, R03, R04"""
    return rounded(_representatives(s, d))


@query(_REP + " select barcode, count(*) as umis, count(*) filter (where ambiguity <> 'CLEAR') as ambiguous_umis, round(count(*) filter (where ambiguity <> 'CLEAR') * 100.0 / count(*), 2) as ambiguous_percent from rep group by 1")
def umi_ambiguity(s: S, d: str) -> DataFrame:
    """R02, A34"""
    return umi.ambiguity_summary(_representatives(s, d), ["barcode"])


@query(f"""with {UMI_SQL}, m as (select *, max(n) over (partition by barcode, umi) as mx from counts), t as (select * from m where n = mx)
  select barcode, umi, string_agg(sequence || ':' || n, ';' order by first_ordinal) as alternatives from t group by 1, 2 having count(*) > 1""")
def umi_alternatives(s: S, d: str) -> DataFrame:
    """R02"""
    return umi.alternatives(umi.sequence_counts(roles.umi_reads(s, d), ["barcode", "umi"]), ["barcode", "umi"])


@query("""with b as (select event_type as sample, user_id as barcode, count(*) as reads, count(distinct regexp_extract(props, '([0-9]+)', 1)) as umi_count from events group by 1, 2)
  select *, cast(row_number() over (partition by sample order by umi_count desc, reads desc, barcode) as bigint) as rank from b""")
def barcode_rank(s: S, d: str) -> DataFrame:
    """A32, R07, R19"""
    r = roles.umi_reads(s, d).join(table(s, d, "events").select("event_id", "event_type"), F.col("ordinal") == F.col("event_id")).withColumnRenamed("event_type", "sample")
    return umi.barcode_rank(r, ["sample"])


@query(_REP + """ select barcode, count(*) as umi_count, cast(sum(total_reads) as bigint) as total_reads, round(round_even(avg(percent), 2), 2) as mean_percent, round_even(median(percent), 2) as median_percent,
  round_even(avg(total_reads), 2) as mean_reads, round_even(avg(unique_sequences), 2) as mean_sequences from rep group by 1""")
def barcode_stats(s: S, d: str) -> DataFrame:
    """A33"""
    return umi.barcode_stats(_representatives(s, d), ["barcode"])


@query(f"""with {UMI_SQL} select barcode, umi, sequence, header, mean_quality from (select *, row_number() over (partition by barcode, umi order by case when mean_quality is null then 1 else 0 end, mean_quality desc, ordinal) as rn from reads) where rn = 1""")
def compact_state(s: S, d: str) -> DataFrame:
    """R05"""
    order = [F.col("mean_quality").isNull().cast("int").asc(), F.desc("mean_quality"), F.asc("ordinal")]
    return ranking.best_per_key(roles.umi_reads(s, d), ["barcode", "umi"], order).select("barcode", "umi", "sequence", "header", "mean_quality")


@query(f"""with {UMI_SQL}, arrived as (select event_id as ordinal, ts >= (select max(ts) - interval 2 day from events) as late from events), old as (select distinct barcode, umi, 'old' as origin from reads join arrived using (ordinal) where not late), new as (select distinct barcode, umi, 'new' as origin from reads join arrived using (ordinal) where late)
  select * from new union all select * from old where not exists (select 1 from new where new.barcode = old.barcode and new.umi = old.umi)""")
def merge_umi_rows(s: S, d: str) -> DataFrame:
    """The reads of the last two days replace the older rows of their UMIs"""
    e = table(s, d, "events")
    at = e.select(F.col("event_id").alias("ordinal"), (F.col("ts") >= e.agg(F.max("ts") - F.expr("interval 2 day")).scalar()).alias("late"))
    r = roles.umi_reads(s, d).join(at, "ordinal")
    side = lambda c, n: r.filter(c).select("barcode", "umi", F.lit(n).alias("origin")).distinct()
    return ranking.replace_rows(side("not late", "old"), side("late", "new"), ["barcode", "umi"])


@query("""with q as (select distinct sample_key as sample, sequence_id as id from observations where sequence_id is not null and sample_key is not null),
  i as (select distinct sample_key as s, sequence_id as alias, match_class as u from observations where sequence_id is not null and match_class is not null),
  c as (select sample, id, min(u) as lo, max(u) as hi from q left join i on s = sample and alias = id group by 1, 2)
  select sample, id, case when lo = hi then lo end as umi, case when lo is null then 'missing' when lo = hi then 'matched' else 'conflict' end as status from c""")
def umi_alias_lookup(s: S, d: str) -> DataFrame:
    """J04, J05, A15, F10; the canonical ids of this table are the ids themselves"""
    o = table(s, d, "observations").filter("sequence_id is not null").select(F.col("sample_key").alias("sample"), F.col("sequence_id").alias("id"), "match_class").distinct()
    index = umi.alias_index(o, "sample", "id", "match_class")
    return umi.lookup_umi(o.filter("sample is not null"), "sample", "id", index)


_CELLS = f"""with {AIRR_SQL}, rows as (select *, cdr3_aa as cdr3 from airr where productive = 'T'),
  k as (select *, coalesce(array_to_string({C.sql_names('upper(trim(v_call))', '[,;|]')}, '|'), '') as v, coalesce(array_to_string({C.sql_names('upper(trim(j_call))', '[,;|]')}, '|'), '') as j, regexp_replace(upper(sequence), '[\\s.\\-]', '', 'g') as variant from rows),
  kk as (select *, case when coalesce(regexp_replace(upper(cdr3), '[\\s.\\-]', '', 'g'), '') <> '' then regexp_replace(upper(cdr3), '[\\s.\\-]', '', 'g') else '__MISSING_CDR3__' || variant end as c3, length(variant) as len from k),
  b as (select *, row_number() over (partition by barcode, locus, v, j, c3, variant order by v_score desc, v_identity desc, len desc, ordinal) as rn from kk),
  vv as (select barcode, locus, v, j, c3, variant, cast(sum(umi_counts) as bigint) as support, min(ordinal) as o1, max(case when rn = 1 then v_score end) as sc, max(case when rn = 1 then v_identity end) as idn, max(case when rn = 1 then len end) as len,
    max(case when rn = 1 then ordinal end) as bo, max(case when rn = 1 then v_call end) as v_call, max(case when rn = 1 then j_call end) as j_call, max(case when rn = 1 then cdr3 end) as cdr3, max(case when rn = 1 then sequence end) as sequence from b group by all),
  vr as (select *, row_number() over (partition by barcode, locus, v, j, c3 order by support desc, sc desc, idn desc, len desc, bo) as variant_rank from vv),
  cl as (select barcode, locus, v, j, c3, cast(sum(support) as bigint) as cs, max(struct_pack(a := sc, b := idn, c := len)) as q, min(o1) as o1, count(*) as nv, max(case when variant_rank = 1 then support end) as s1, max(case when variant_rank = 2 then support end) as s2,
    max(case when variant_rank = 1 then v_call end) as v_call, max(case when variant_rank = 1 then j_call end) as j_call, max(case when variant_rank = 1 then cdr3 end) as cdr3 from vr group by all),
  cr as (select *, row_number() over w as chain_rank, first_value(cs) over w as top from cl window w as (partition by barcode, locus order by cs desc, q.a desc, q.b desc, q.c desc, o1)),
  cf as (select *, case when chain_rank = 1 then 'PRIMARY' when chain_rank > 2 then 'EXCESS_CHAIN_CANDIDATE' when cs > 0 and (cast(top as double) / cs < 3 or cast(cs as double) / (top + cs) >= 0.1) then 'SECONDARY_SUPPORTED' else 'SECONDARY_DOMINATED' end as reason from cr),
  cg as (select *, case when reason not in ('PRIMARY', 'SECONDARY_SUPPORTED') then 0 when coalesce(s2, 0) > 0 and (cast(s1 as double) / s2 < 3 or cast(s2 as double) / (s1 + s2) >= 0.1) then 2 else 1 end as ov from cf)"""


def _cells(s: S, d: str) -> tuple[DataFrame, DataFrame]:
    a = roles.airr(s, d).filter("productive = 'T'").withColumn("cdr3", F.col("cdr3_aa")).withColumn("sequence_alignment", F.lit(None).cast("string"))
    a = a.withColumns({f"{x}_alignment_{e}": F.lit(None).cast("int") for x in "vdjc" for e in ("start", "end")})
    return cells.cluster_chains(a, ["barcode"], "ordinal")


@query(_CELLS + """ select barcode, locus, cast(chain_rank as int) as chain_rank, cast(variant_rank as int) as variant_rank, vr.v_call, vr.j_call, vr.cdr3, sequence, support as umi_counts from vr join cg using (barcode, locus, v, j, c3) where variant_rank <= ov""")
def chain_cluster(s: S, d: str) -> DataFrame:
    """R08-R12"""
    return _cells(s, d)[0]


@query(_CELLS + " select barcode, locus, cast(chain_rank as int) as chain_rank, v_call, j_call, cdr3, cs as cluster_umi_counts, nv as all_variants, cast(ov as int) as output_variants, reason in ('PRIMARY', 'SECONDARY_SUPPORTED') as retained, reason as retention_reason from cg")
def chain_summary(s: S, d: str) -> DataFrame:
    """R13"""
    return _cells(s, d)[1]


@query(f"""with {AIRR_SQL}, x as (select barcode, case when locus in ('TRA', 'TRB') then locus else 'other' end as l, umi_counts as n, ordinal from airr)
  select barcode, count(*) as source_rows, """ + ", ".join(f"""count(*) filter (where l = '{l}') as "{l}_rows", """ + (f"""cast(coalesce(sum(n) filter (where l = '{l}'), 0) as bigint) as "{l}_sum", coalesce(max(n) filter (where l = '{l}'), 0) as "{l}_max", """ if l != "other" else "") + f"""coalesce(string_agg(cast(n as varchar), ';' order by ordinal, n) filter (where l = '{l}'), '') as "{l}_values" """ for l in ("TRA", "TRB", "other")) + """,
  case when count(*) filter (where l = 'TRA') > 0 and count(*) filter (where l = 'TRB') > 0 then 'BOTH' when count(*) filter (where l = 'TRA') > 0 then 'TRA_ONLY' when count(*) filter (where l = 'TRB') > 0 then 'TRB_ONLY' else 'NO_TRA_TRB' end as chain_status, 'OK' as status from x group by 1""")
def sequence_chain_summary(s: S, d: str) -> DataFrame:
    """A35"""
    return cells.sequence_chain_summary(roles.airr(s, d), "barcode", ["ordinal"])


@query("""with o as (select distinct id, sequence from observations where sequence is not null)
  select id, case when length(sequence) < 18 then 'short' when substr(upper(sequence), 11, 8) = 'GTTCAGAT' then 'match' else 'mismatch' end as state from o""")
def barcode_demux(s: S, d: str) -> DataFrame:
    """F25"""
    o = roles.observations(s, d, "sequence").filter("sequence is not null")
    return o.select("id", H.bulk_parts("sequence", F.lit("GTTCAGAT"))["state"].alias("state"))


@query("""with o as (select distinct id, sequence from observations where sequence is not null), p as (select id, upper(sequence) as s, case when substr(upper(sequence), 27, 2) = 'AC' then 27 else 0 end as a from o)
  select id, cast(a as int) as tso_at, case when a > 0 then substr(s, 1, 16) end as barcode, case when a > 0 then substr(s, 17, 10) end as umi, case when a > 0 then substr(s, 29) end as insert_seq from p""")
def tso_extract(s: S, d: str) -> DataFrame:
    """F23, F24"""
    o = roles.observations(s, d, "sequence").filter("sequence is not null").withColumn("p", H.tso_parts("sequence", "AC"))
    return o.select("id", "p.tso_at", "p.barcode", "p.umi", F.col("p.insert").alias("insert_seq"))


@query("""with o as (select distinct id, sequence from observations where sequence is not null) select id, reverse(translate(upper(sequence), 'ACGTRYKMBVDHN', 'TGCAYRMKVBHDN')) as rc from o""")
def reverse_complement(s: S, d: str) -> DataFrame:
    """Y01"""
    return roles.observations(s, d, "sequence").filter("sequence is not null").select("id", H.reverse_complement("sequence").alias("rc"))


@query(f"""with {AIRR_SQL}, h as (select ordinal, cdr3_aa, umi_counts from airr where cdr3_aa is not null) select distinct ordinal || '_' || cdr3_aa || '_' || umi_counts as header, ordinal as row, cdr3_aa as cdr3, umi_counts as copies from h""")
def mapping_header_roundtrip(s: S, d: str) -> DataFrame:
    """U03, K14"""
    h = roles.airr(s, d).filter("cdr3_aa is not null").select(sinks.mapping_header(F.col("ordinal"), F.col("cdr3_aa"), F.col("umi_counts").cast("string")).alias("header")).distinct()
    return h.withColumn("p", sinks.split_mapping_header("header")).select("header", "p.row", "p.cdr3", "p.copies")


def _shm(s: S, d: str) -> DataFrame:
    return bcell.with_shm(roles.hypermutated(s, d))


@query(f"with {HYPERMUTATED_SQL} select id, v as v_shm, round(vr, 6) as v_shm_ratio, t as tt_shm, round(tr, 6) as tt_shm_ratio from shm")
def shm_alignment(s: S, d: str) -> DataFrame:
    """Alignments of real length whose changes are known"""
    return rounded(_shm(s, d).select("id", "v_shm", "v_shm_ratio", "tt_shm", "tt_shm_ratio"))


_GENE = f"with {HYPERMUTATED_SQL}, g as (select *, {C.sql_unique_gene('c_call')} as gene from shm)"
_SHARES = ", ".join(
    f"round(cast(coalesce(sum(w) filter (where {n} {c} {op} 0), 0) as double) / sum(w) filter (where {n} true), 6) as {c_name}_{prefix}{state}"
    for c, c_name in (("v", "v"), ("t", "tt")) for prefix, n in (("", ""), ("naive_", "naive and")) for state, op in (("mutated", "<>"), ("unmutated", "="))
)


@query(_GENE + f" select sample, {_SHARES} from (select *, coalesce(contains(gene, 'IGHD') or contains(gene, 'IGHM'), false) as naive from g where locus = 'IGH') group by 1")
def shm_metrics(s: S, d: str) -> DataFrame:
    """A08"""
    return rounded(bcell.shm_shares(_shm(s, d), ["sample"]))


_MEANS = ", ".join(f"round(cast(sum(coalesce({c}, 0) * w) as double) / sum(w), 6) as {n}" for c, n in (("v", "v_shm"), ("vr", "v_shm_ratio"), ("t", "tt_shm"), ("tr", "tt_shm_ratio")))


@query(f"with {HYPERMUTATED_SQL} select sample, locus, {_MEANS} from shm group by 1, 2")
def shm_by_locus(s: S, d: str) -> DataFrame:
    """A09"""
    return rounded(bcell.shm_by_locus(_shm(s, d), ["sample"]))


@query(_GENE + f""", h as (select *, case when gene in ('IGHD', 'IGHM') then 'IgD/M' else 'Ig' || substr(gene, 4) end as isotype from g where locus = 'IGH' and contains(gene, 'IGH')),
  p as (select sample, gene, isotype, avg(v * w) as v_shm, avg(vr * w) as v_shm_ratio, avg(t * w) as tt_shm, avg(tr * w) as tt_shm_ratio, count(*) as records, cast(sum(w) as bigint) as copies from h group by all),
  m as (select sample, isotype, sum(v_shm_ratio * records) / sum(copies) * 100 as x from p group by 1, 2)
  select sample, gene, isotype, round(v_shm, 6) as v_shm, round(v_shm_ratio, 6) as v_shm_ratio, round(tt_shm, 6) as tt_shm, round(tt_shm_ratio, 6) as tt_shm_ratio, records, copies, case when x between 0 and 100 then round(x, 6) end as mean_shm_percent from p left join m using (sample, isotype) where sample is not null""")
def shm_by_isotype(s: S, d: str) -> DataFrame:
    """A10, A11"""
    return rounded(bcell.shm_by_isotype(_shm(s, d).filter("sample is not null"), ["sample"]))
