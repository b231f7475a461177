"""Queries of the usage, primer, lineage, stage, matching and export operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vdjloom.functions import calls as C
from vdjloom.functions import headers as H
from vdjloom.functions.text import pct
from vdjloom.functions.values import utc_time, valid_sequence
from vdjloom.operators import bcell, lineage, matching, primers, ranking, stages, umi, usage
from vdjloom.plans import roles
from vdjloom.plans.durable import settle
from vdjloom.plans.repertoire import rounded
from vdjloom.plans.roles import AIRR_SQL, MATCH_SQL, PRIMER_SQL, PRIMERS, RECORDS_SQL, obs_sql
from vdjloom.sources import sinks
from vdjloom.sources.tables import table
from vdjloom.streaming import windows

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


# --- gene usage -----------------------------------------------------------------------------

_MEMBERS = f"""with {RECORDS_SQL}, e as (select id, group_id, case when sample_record = 1 then '' else primer end as primer, weight, aa_field, aa_value, aa_valid from records where eligible = 1 and (sample_record = 1 or primer <> '')),
  m as (select e.*, segment, gene, assignment from e join calls on record_id = id)"""
_USAGE = _MEMBERS + """, counts as (select group_id, primer, segment, gene, assignment, coalesce(sum(weight), 0) as n from m group by all),
  gc as (select distinct group_id, substr(gene, 1, 3) as chain from m where gene <> ''), ref as (select distinct group_id, segment, gene from gc join (select distinct segment, gene from calls where assignment = 'unique' and gene <> '' and right(gene, 1) <> '6') g on substr(g.gene, 1, 3) = chain),
  pr as (select distinct group_id, primer from counts), keys as (select group_id, primer, segment, gene from pr join ref using (group_id) union select group_id, primer, segment, gene from counts where gene <> ''),
  per as (select group_id, primer, segment, gene, coalesce(sum(n) filter (where assignment = 'unique'), 0) as u, coalesce(sum(n) filter (where assignment = 'ambiguous'), 0) as a from counts group by all),
  den as (select group_id, primer, segment, sum(u) as d from per group by all), av as (select distinct group_id, segment, 1 as av from ref),
  usage as (select k.group_id, k.primer, k.segment, k.gene, cast(coalesce(u, 0) as bigint) as unique_count, cast(coalesce(a, 0) as bigint) as ambiguous_count, cast(coalesce(d, 0) as bigint) as denominator,
    case when d > 0 then round(cast(100 as double) * coalesce(u, 0) / d, 6) end as percent, cast(case when ref.gene is null then 0 else 1 end as int) as reference_catalog,
    case when ref.gene is null and av.av = 1 and coalesce(u, 0) + coalesce(a, 0) > 0 then 'outside_reference' when coalesce(u, 0) > 0 then 'observed' when coalesce(a, 0) > 0 then 'ambiguous_only' else 'zero_observed' end as status
    from keys k left join per using (group_id, primer, segment, gene) left join den using (group_id, primer, segment) left join ref on ref.group_id = k.group_id and ref.segment = k.segment and ref.gene = k.gene left join av on av.group_id = k.group_id and av.segment = k.segment)"""


def _usage(s: S, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, calls, gene usage). The reference of a group: the genes of its chains that do not end in 6."""
    r, c = roles.records(s, d), roles.calls(s, d)
    counts = usage.usage_counts(r, c)
    chains = counts.filter("gene <> ''").select("group_id", F.substring("gene", 1, 3).alias("_chain")).distinct()
    genes = c.filter("assignment = 'unique' and gene <> '' and right(gene, 1) <> '6'").select("segment", "gene", F.substring("gene", 1, 3).alias("_c")).distinct()
    reference = chains.join(genes, F.col("_chain") == F.col("_c")).select("group_id", "segment", "gene")
    return r, c, usage.gene_usage(counts, reference, counts.select("group_id", "primer"))


@query(_USAGE + " select * from usage")
def gene_usage_expression(s: S, d: str) -> DataFrame:
    """A18, A19, J09, X01"""
    return rounded(_usage(s, d)[2])


@query(_USAGE + " select group_id, primer, segment, gene from usage where status = 'zero_observed' and reference_catalog = 1")
def gene_zero_observed(s: S, d: str) -> DataFrame:
    """J09, F32"""
    return usage.usage_filter(_usage(s, d)[2], zero_only=True, reference_only=True).select("group_id", "primer", "segment", "gene")


@query(_USAGE + " select group_id, primer, segment, gene, unique_count from usage where (unique_count > 0 or (ambiguous_count = 0 and status = 'zero_observed')) and contains(lower(gene), 'v1')")
def gene_usage_selection(s: S, d: str) -> DataFrame:
    """F32, L03"""
    return usage.usage_filter(_usage(s, d)[2], definite_only=True, name="V1").select("group_id", "primer", "segment", "gene", "unique_count")


_UNIQUE = _USAGE + """, aa as (select group_id, primer, segment, gene, assignment, count(distinct aa_value) as n from m where aa_valid = 1 and aa_field = 'cdr3_aa' group by all),
  aper as (select group_id, primer, segment, gene, coalesce(sum(n) filter (where assignment = 'unique'), 0) as u, coalesce(sum(n) filter (where assignment = 'ambiguous'), 0) as a from aa group by all),
  aden as (select group_id, primer, segment, sum(u) as d from aper group by all), gf as (select distinct group_id from records where eligible = 1 and aa_field = 'cdr3_aa'),
  uniq as (select g.group_id, g.primer, g.segment, g.gene, cast(coalesce(u, 0) as bigint) as unique_count, cast(coalesce(a, 0) as bigint) as ambiguous_count, cast(coalesce(d, 0) as bigint) as denominator,
    case when d > 0 then round(cast(100 as double) * coalesce(u, 0) / d, 6) end as percent, reference_catalog, status from usage g join gf using (group_id) left join aper using (group_id, primer, segment, gene) left join aden using (group_id, primer, segment))"""


def _unique(s: S, d: str) -> tuple[DataFrame, DataFrame]:
    r, c, e = _usage(s, d)
    return e, usage.unique_cdr3_usage(e, usage.unique_cdr3_counts(r, c), r.filter("eligible = 1 and aa_field = 'cdr3_aa'"))


@query(_UNIQUE + " select * from uniq")
def gene_usage_unique_cdr3(s: S, d: str) -> DataFrame:
    """A20"""
    return rounded(_unique(s, d)[1])


@query(_UNIQUE + """ select metric, segment, status, count(*) as n, cast(sum(unique_count) as bigint) as unique_count from (select *, 'expression' as metric from usage union all select *, 'unique_cdr3' from uniq) group by all""")
def gene_usage_metrics(s: S, d: str) -> DataFrame:
    """X02"""
    return usage.all_usage(*_unique(s, d)).groupBy("metric", "segment", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("unique_count").alias("unique_count"))


@query(_USAGE + """, k as (select * from usage where reference_catalog = 1) select group_id, primer, segment, gene, unique_count, cast(sum(unique_count) over p as bigint) as denominator,
  case when sum(unique_count) over p > 0 then round(cast(100 as double) * unique_count / sum(unique_count) over p, 6) end as percent from k window p as (partition by group_id, primer, segment)""")
def gene_usage_rebased(s: S, d: str) -> DataFrame:
    """Percentages again over the genes of the reference"""
    e = _usage(s, d)[2].filter("reference_catalog = 1").withColumn("metric", F.lit("expression")).withColumn("aa_field", F.lit(""))
    return rounded(usage.rebase(e).select("group_id", "primer", "segment", "gene", "unique_count", "denominator", "percent"))


@query(f"with {RECORDS_SQL}, t as (select group_id, case when sample_record = 1 then '' else coalesce(primer, '') end as primer, coalesce(sum(weight), 0) as t from records where eligible = 1 group by all), " + _USAGE[len(f"with {RECORDS_SQL}, "):] + """
  select group_id, primer, segment, cast(t as bigint) as total_count, max(denominator) as classified_count, case when t <> 0 then round(cast(100 as double) * max(denominator) / t, 6) end as coverage_percent from usage join t using (group_id, primer) group by group_id, primer, segment, t""")
def annotation_coverage(s: S, d: str) -> DataFrame:
    """A27"""
    r, _, e = _usage(s, d)
    return rounded(usage.annotation_coverage(r, e))


@query(_USAGE + """ select group_id, primer, gene, unique_count, case when sum(unique_count) over p <> 0 then round(cast(100 as double) * unique_count / sum(unique_count) over p, 6) end as percent from usage where segment = 'C' and primer <> '' window p as (partition by group_id, primer)""")
def primer_composition(s: S, d: str) -> DataFrame:
    """A45"""
    return rounded(usage.primer_composition(_usage(s, d)[2]))


_ALIGN = _USAGE + """, u as (select substr(gene, 1, 3) as chain, segment, group_id, gene, percent from usage where primer = '' and gene <> ''), ok as (select chain, segment from u group by all having count(distinct group_id) >= 2),
  w as (select distinct u.chain, u.segment, group_id from u join ok using (chain, segment)), ax as (select chain, segment, gene, max(percent) as mx from u join ok using (chain, segment) group by all having max(percent) > 0)
  select ax.chain, ax.segment, ax.gene, w.group_id, round(coalesce(u.percent, 0), 6) as percent, round(mx, 6) as max_percent from ax join w using (chain, segment) left join u using (chain, segment, gene, group_id)"""


@query(_ALIGN)
def gene_alignment(s: S, d: str) -> DataFrame:
    """J23"""
    u = _usage(s, d)[2].filter("primer = '' and gene <> ''").withColumn("chain", F.substring("gene", 1, 3))
    return rounded(usage.align_genes(u, "group_id"))


@query(f"""with {RECORDS_SQL}, b as (select group_id, count(*) as records, count(*) filter (where eligible <> 1) as excluded, count(*) filter (where aa_valid = 1) as valid_aa from records group by 1)
  select group_id, 'records' as fact, '' as name, records as value from b union all select group_id, 'excluded', '', excluded from b union all select group_id, 'valid_aa', '', valid_aa from b
  union all select group_id, 'isotype_state', isotype_state, count(*) from records where eligible = 1 group by all
  union all select group_id, 'assignment', segment || ':' || assignment, count(*) from records join (select distinct record_id, segment, assignment from calls) on record_id = id where eligible = 1 group by all""")
def group_metadata(s: S, d: str) -> DataFrame:
    """A25"""
    return usage.group_metadata(roles.records(s, d), roles.calls(s, d))


@query(f"""with {RECORDS_SQL}, dup as (select group_id, aa_value from records group by all having count(*) > 1)
  select r.id, cast(case when d.group_id is not null then 0 else eligible end as int) as eligible from records r left join dup d on r.group_id = d.group_id and r.aa_value is not distinct from d.aa_value""")
def duplicate_demotion(s: S, d: str) -> DataFrame:
    """J11, F08"""
    return usage.demote_duplicates(roles.records(s, d), ["group_id", "aa_value"]).select("id", "eligible")


_ALLOC = f"""with {RECORDS_SQL}, l as (select group_id, identity_key, coalesce(primer, '') as primer, sum(case when sample_record = 0 then weight else 1 end) as n from records where weight > 0 group by all),
  tot as (select group_id, identity_key, sum(n) as n from l group by all), one as (select group_id, identity_key from records where sample_record = 1 group by all having count(*) = 1),
  ex as (select r.group_id, r.identity_key, r.id from records r join one using (group_id, identity_key) join tot using (group_id, identity_key) where r.sample_record = 1 and r.weight = tot.n),
  al as (select ex.group_id, id, primer, n from ex join l using (group_id, identity_key) where primer <> '')"""


def _allocation(s: S, d: str) -> tuple[DataFrame, DataFrame]:
    r = roles.records(s, d)
    n = F.sum(F.when(F.col("sample_record") == 0, F.col("weight")).otherwise(1)).alias("n")
    return usage.allocate_copies(r, r.filter("weight > 0").groupBy("group_id", "identity_key", F.coalesce("primer", F.lit("")).alias("primer")).agg(n))


@query(_ALLOC + " select group_id, id, primer, cast(n as bigint) as copies from al")
def copy_allocation(s: S, d: str) -> DataFrame:
    """J12, U04"""
    return _allocation(s, d)[0]


@query(_ALLOC + """ select r.group_id, count(*) as records, cast(coalesce(sum(weight), 0) as bigint) as copies, cast(coalesce((select sum(n) from al where al.group_id = r.group_id), 0) as bigint) as allocated,
  cast(coalesce(sum(weight), 0) - coalesce((select sum(n) from al where al.group_id = r.group_id), 0) as bigint) as unresolved from records r where sample_record = 1 group by 1""")
def copy_allocation_totals(s: S, d: str) -> DataFrame:
    """J12"""
    return _allocation(s, d)[1]


# --- isotypes -------------------------------------------------------------------------------

_ISO = f"with {RECORDS_SQL}, r as (select * from records where eligible = 1 and sample_record = 1)"


def _eligible(s: S, d: str) -> DataFrame:
    return roles.records(s, d).filter("eligible = 1 and sample_record = 1")


@query(_ISO + """, t as (select group_id, coalesce(sum(weight), 0) as tr, coalesce(sum(weight) filter (where isotype_main <> ''), 0) as ar, max(case when aa_field = 'cdr3_aa' then 1 else 0 end) as has from r group by 1),
  ab as (select group_id, isotype_main as isotype, coalesce(sum(weight), 0) as c from r where isotype_main <> '' group by 1, 2), v as (select * from r where isotype_main <> '' and aa_field = 'cdr3_aa' and aa_valid = 1),
  un as (select group_id, isotype_main as isotype, count(distinct aa_value) as c from v group by 1, 2), gl as (select group_id, count(distinct aa_value) as g, coalesce(sum(weight), 0) as w from v group by 1)
  select group_id, 'abundance' as metric, isotype, cast(c as bigint) as count, cast(sum(c) over p as bigint) as denominator, case when sum(c) over p <> 0 then round(cast(100 as double) * c / sum(c) over p, 6) end as percent, cast(tr as bigint) as total_records, cast(ar as bigint) as annotated_records,
    cast(tr - ar as bigint) as excluded_records, cast(null as bigint) as valid_aa_records, cast(null as bigint) as global_unique_cdr3 from ab join t using (group_id) window p as (partition by group_id)
  union all select group_id, 'unique_cdr3', coalesce(isotype, ''), coalesce(c, 0), cast(coalesce(sum(c) over p, 0) as bigint), case when sum(c) over p <> 0 then round(cast(100 as double) * c / sum(c) over p, 6) end, cast(tr as bigint), cast(ar as bigint),
    cast(tr - coalesce(w, 0) as bigint), cast(coalesce(w, 0) as bigint), coalesce(g, 0) from t left join un using (group_id) left join gl using (group_id) where has = 1 window p as (partition by group_id)""")
def isotype_summary(s: S, d: str) -> DataFrame:
    """A22"""
    return rounded(bcell.isotype_summary(_eligible(s, d)))


_CM = f"with {RECORDS_SQL}, m as (select r.*, gene from records r join calls on record_id = id where sample_record = 1 and segment = 'C' and assignment = 'unique' and isotype_main <> '')"


@query(_CM + """, g as (select group_id, gene, count(*) as records, sum(weight) as copies, count(distinct case when aa_valid = 1 then aa_value end) as unique_cdr3 from m group by 1, 2)
  select group_id, gene, records, cast(copies as bigint) as copies, unique_cdr3, case when sum(copies) over p <> 0 then round(cast(100 as double) * copies / sum(copies) over p, 6) end as copy_percent, case when sum(unique_cdr3) over p <> 0 then round(cast(100 as double) * unique_cdr3 / sum(unique_cdr3) over p, 6) end as cdr3_percent
  from g window p as (partition by group_id)""")
def isotype_distribution(s: S, d: str) -> DataFrame:
    """A23"""
    return rounded(bcell.isotype_distribution(roles.records(s, d).filter("sample_record = 1"), roles.calls(s, d)))


@query(_CM + """, p as (select distinct group_id, aa_value, case when gene in ('IGHD', 'IGHM') then 'IgD/M' when starts_with(gene, 'IGH') then 'Ig' || substr(gene, 4) else gene end as isotype from m where aa_valid = 1 and lower(aa_value) not in ('', 'nan', 'na', 'none', 'null')),
  k as (select *, count(*) over (partition by group_id, aa_value) as n from p)
  select group_id, isotype, count(*) as unique_cdr3, count(*) filter (where n > 1) as shared_cdr3, round(cast(100 as double) * count(*) filter (where n > 1) / count(*), 6) as shared_cdr3_percent from k group by 1, 2""")
def isotype_shared_cdr3(s: S, d: str) -> DataFrame:
    """A24, J15"""
    return rounded(bcell.shared_cdr3(roles.records(s, d).filter("sample_record = 1"), roles.calls(s, d)))


# --- primers --------------------------------------------------------------------------------


def _categorised(s: S, d: str) -> DataFrame:
    return primers.categorise(roles.observations(s, d, "sample_key", "chain", "sequence", "filter_reason", "v_call"), "sequence", PRIMERS)


_SUMMARY = MATCH_SQL + """, n as (select sample_key, count(*) as n_all, count(*) filter (where match_class = 'unique') as u, count(*) filter (where match_class = 'multiple') as m, count(*) filter (where match_class = 'unmatched') as x from cat group by 1),
  su as (select sample_key, unnest(['unique', 'multiple', 'unmatched']) as match_class, unnest([u, m, x]) as count, u + m + x as denominator, n_all - u - m - x as unassessed_count from n)"""


@query(f"with {MATCH_SQL} select id, match_class, array_to_string(names, ',') as names, array_to_string(families, ',') as families from cat")
def primer_match(s: S, d: str) -> DataFrame:
    """P01, P06"""
    return _categorised(s, d).select("id", "match_class", F.array_join("names", ",").alias("names"), F.array_join("families", ",").alias("families"))


@query(f"""with {MATCH_SQL}, l as (select *, list_distinct(list_transform(families, lambda x: length(x))) as ls from cat), t as (select *, case when sequence is null then 'structure_untrimmed' when len(ls) > 1 then 'ambiguous_length_untrimmed' when len(ls) = 0 then 'unmatched_untrimmed'
  when ls[1] >= length(sequence) then 'primer_only_untrimmed' when len(names) = 1 then 'trimmed_unique' else 'trimmed_multi_same_length' end as trim_state from l)
  select id, trim_state, cast(case when starts_with(trim_state, 'trimmed') then ls[1] else 0 end as int) as trim_length from t""")
def primer_trim(s: S, d: str) -> DataFrame:
    """P05, P02"""
    return _categorised(s, d).select("id", "trim_state", F.col("trim_length").cast("int").alias("trim_length"))


def _summary(c: DataFrame) -> DataFrame:
    return primers.match_summary(primers.by_class(c, ["sample_key"]), ["sample_key"])


@query("with " + _SUMMARY + " select *, case when denominator <> 0 then round(cast(100 as double) * count / denominator, 6) end as percent from su")
def primer_match_summary(s: S, d: str) -> DataFrame:
    """P09"""
    return rounded(_summary(_categorised(s, d)))


@query("with " + _SUMMARY + """, p as (select *, case when denominator <> 0 then cast(100 as double) * count / denominator end as percent from su where match_class = 'unique')
  select sample_key, case when denominator > 0 then denominator end as total_reads, round(percent, 6) as unique_percent, unassessed_count, case when denominator = 0 then 'unavailable' when unassessed_count > 0 then 'review' when percent < 30 then 'low' else 'ok' end as status from p""")
def primer_precheck(s: S, d: str) -> DataFrame:
    """P12"""
    return rounded(primers.precheck(_summary(_categorised(s, d)), ["sample_key"], 30.0))


_ALT = MATCH_SQL + """, a as (select o.sample_key, o.id, grp, count(distinct name) as k from obs o join primers on regexp_matches(upper(sequence), pattern) where grp <> 'gA' group by all),
  ha as (select id, count(distinct name) as k from obs join primers on regexp_matches(upper(sequence), pattern) where grp = 'gA' group by 1),
  base as (select sample_key, count(*) as denominator, count(*) filter (where ha.k = 1) as u from obs left join ha using (id) where length(sequence) > 0 group by 1), low as (select *, cast(100 as double) * u / denominator as op from base where cast(100 as double) * u / denominator < 50),
  g as (select sample_key, grp, count(*) filter (where k = 1) as u, count(*) filter (where k > 1) as m from a group by 1, 2),
  alt as (select low.sample_key, t.grp as tested_group, denominator, round(op, 6) as original_unique_percent, coalesce(g.u, 0) as unique_count, coalesce(g.m, 0) as multiple_count, denominator - coalesce(g.u, 0) - coalesce(g.m, 0) as unmatched_count, round(cast(100 as double) * coalesce(g.u, 0) / denominator, 6) as unique_percent,
    case when cast(100 as double) * coalesce(g.u, 0) / denominator >= 50 and cast(100 as double) * coalesce(g.u, 0) / denominator > op then 'suspected' else 'below_threshold' end as status
  from low cross join (select unnest(['gB', 'gC']) as grp) t left join g on g.sample_key is not distinct from low.sample_key and g.grp = t.grp)"""


def _alternatives(s: S, d: str, threshold: float = 50.0) -> tuple[DataFrame, DataFrame]:
    r = roles.observations(s, d, "sample_key", "sequence").filter("length(sequence) > 0")
    own = primers.categorise(r, "sequence", [p for p in PRIMERS if p[2] == "gA"])
    return r, primers.alternative_groups(r, "sequence", ["sample_key"], PRIMERS, "gA", _summary(own), threshold)


@query("with " + _ALT + " select * from alt")
def primer_alternatives(s: S, d: str) -> DataFrame:
    """P10, P11"""
    return rounded(_alternatives(s, d)[1])


@query("with " + _ALT.replace(">= 50 and", ">= 5 and") + """, sus as (select sample_key, tested_group from alt where status = 'suspected'),
  r as (select o.sample_key, o.id, tested_group from obs o join sus on sus.sample_key is not distinct from o.sample_key where length(o.sequence) > 0),
  c as (select r.sample_key, r.tested_group, r.id, count(distinct name) as k from r left join (select id, name, grp from obs join primers on regexp_matches(upper(sequence), pattern)) h on h.id = r.id and h.grp = r.tested_group group by all)
  select sample_key, tested_group, case when k = 1 then 'unique' when k > 1 then 'multiple' else 'unmatched' end as match_class, count(*) as n from c group by all""")
def primer_scenarios(s: S, d: str) -> DataFrame:
    """P13, P07"""
    r, alt = _alternatives(s, d)
    low = F.when((F.col("unique_percent") >= 5) & (F.col("unique_percent") > F.col("original_unique_percent")), "suspected").otherwise("below_threshold")
    x = primers.scenarios(r, "sequence", PRIMERS, alt.withColumn("status", low), ["sample_key"])
    return x.groupBy("sample_key", "tested_group", "match_class").agg(F.count(F.lit(1)).alias("n"))


_SCENARIO = f"""with {PRIMER_SQL}, o as (select distinct id, chain, upper(sequence) as s, filter_reason, v_call from observations where sequence <> '' and chain is not null),
  h as (select o.id, chain, grp, count(distinct name) as k, min(name) as name from o join primers on regexp_matches(s, pattern) group by 1, 2, 3), den as (select chain, count(*) as n from o group by 1),
  base as (select den.chain, n, cast(100 as double) * (select count(*) from h where h.chain = den.chain and grp = 'gA' and k = 1) / n as op from den),
  sus as (select chain, grp, left(sha256(chain || chr(0) || grp), 16) as sid from (select base.chain, t.grp, op, cast(100 as double) * (select count(*) from h where h.chain = base.chain and h.grp = t.grp and k = 1) / n as p from base cross join (select unnest(['gB', 'gC']) as grp) t where op < 50) where p >= 5 and p > op),
  fin as (select id, chain, left(s, 6) as identity_key from o where filter_reason = 'retained'), rec as (select chain, left(s, 6) as identity_key, min(id) as rid, count(*) as w, min(v_call) as v from o where filter_reason in ('retained', 'retained_history') group by 1, 2),
  lin as (select sid, identity_key, case when h.k = 1 then h.name else '' end as primer, count(*) as n from fin join sus using (chain) left join h on h.id = fin.id and h.grp = sus.grp group by 1, 2, 3), tot as (select sid, identity_key, sum(n) as n from lin group by 1, 2),
  ex as (select sid, identity_key, rid, v from rec join sus using (chain) join tot using (sid, identity_key) where w = tot.n), al as (select ex.*, primer, n from ex join lin using (sid, identity_key) where primer <> '')"""


def _scenarios(s: S, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scenarios of chains: final rows are the retained observations, records those and the retained history of one beginning."""
    o = roles.observations(s, d, "chain", "sequence", "filter_reason", "v_call").filter("sequence <> '' and chain is not null").withColumnRenamed("chain", "group_id").withColumn("identity_key", F.upper(F.substring("sequence", 1, 6)))
    own = primers.categorise(o, "sequence", [p for p in PRIMERS if p[2] == "gA"])
    alt = primers.alternative_groups(o, "sequence", ["group_id"], PRIMERS, "gA", primers.match_summary(primers.by_class(own, ["group_id"]), ["group_id"]))
    alt = alt.withColumn("status", F.when((F.col("unique_percent") >= 5) & (F.col("unique_percent") > F.col("original_unique_percent")), "suspected").otherwise("below_threshold"))
    m = settle(primers.scenarios(o.select("id", "group_id", "sequence"), "sequence", PRIMERS, alt, ["group_id"]).drop("sequence"))
    lineage_ = usage.scenario_lineage(m, o.filter("filter_reason = 'retained'").select("group_id", "id", "identity_key"), ["id"])
    r = o.filter("filter_reason in ('retained', 'retained_history')").groupBy("group_id", "identity_key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"), F.min("v_call").alias("v_call"))
    r = r.withColumns({"sample_record": F.lit(1), "aa_field": F.lit("cdr3_aa"), "aa_value": F.col("identity_key"), "aa_valid": F.lit(1)})
    g = r.select(F.col("id").alias("record_id"), F.lit("V").alias("segment"), C.calls("v_call").alias("g"))
    lineage_, r = settle(lineage_), settle(r.drop("v_call"))
    return usage.scenario_records(r, g.select("record_id", "segment", F.explode("g").alias("gene"), C.assignment(F.col("g")).alias("assignment")), lineage_, m.select("scenario_id", "group_id"))


@query(_SCENARIO + """ select sid as scenario_id, count(*) as records, cast(sum(w) as bigint) as copies, cast(coalesce((select sum(n) from al where al.sid = sus.sid), 0) as bigint) as allocated, cast(sum(w) - coalesce((select sum(n) from al where al.sid = sus.sid), 0) as bigint) as unresolved from rec join sus using (chain) group by 1""")
def scenario_totals(s: S, d: str) -> DataFrame:
    """Copies given to the primers of each scenario"""
    return _scenarios(s, d)[2].withColumnRenamed("group_id", "scenario_id")


@query(_SCENARIO + f""", c as (select sid, primer, n, {C.sql_calls('v')} as g from al), e as (select sid, primer, n, len(g) = 1 as one, unnest(g) as gene from c),
  u as (select sid, primer, gene, cast(coalesce(sum(n) filter (where one), 0) as bigint) as unique_count, cast(coalesce(sum(n) filter (where not one), 0) as bigint) as ambiguous_count from e group by 1, 2, 3)
  select sid as scenario_id, primer, gene, unique_count, ambiguous_count, cast(sum(unique_count) over p as bigint) as denominator, case when sum(unique_count) over p > 0 then round(cast(100 as double) * unique_count / sum(unique_count) over p, 6) end as percent from u window p as (partition by sid, primer)""")
def scenario_usage(s: S, d: str) -> DataFrame:
    """Gene usage of each scenario from its allocated copies"""
    r, c, _ = _scenarios(s, d)
    u = usage.gene_usage(usage.usage_counts(r, c)).withColumnRenamed("group_id", "scenario_id")
    return rounded(u.select("scenario_id", "primer", "gene", "unique_count", "ambiguous_count", "denominator", "percent"))


@query(f"""with {MATCH_SQL}, b as (select sample_key, chain, case match_class when 'unique' then names[1] when 'multiple' then '[Multiple]' when 'unmatched' then '[Unmatched]' else '[Unassessed]' end as primer,
  case when v_call is not null and upper(trim(v_call)) not in ('', '*', '-', 'NA', 'N/A', 'NONE', 'NULL', 'NO_HIT', 'UNMAPPED', 'NOT_FOUND') and contains(v_call, chain) then 1 else 0 end as mapped, filter_reason from cat),
  g as (select sample_key, chain, primer, count(*) as matched_reads, cast(sum(mapped) as bigint) as mapped_reads, count(*) filter (where filter_reason in ('retained', 'retained_history', 'imported_result')) as retained_reads,
   count(*) filter (where filter_reason in ('ambiguous_lineage', 'pair_identity_unverified', 'duplicate_airr_rows', 'fastp_membership_unavailable', 'clean_membership_unavailable')) as unverified_reads from b group by 1, 2, 3)
  select *, cast(sum(matched_reads) over p as bigint) as total_reads, round(cast(100 as double) * matched_reads / sum(matched_reads) over p, 6) as match_percent, case when unverified_reads = 0 then round(cast(100 as double) * mapped_reads / matched_reads, 6) end as mapping_percent from g window p as (partition by sample_key, chain)""")
def primer_mapping_rate(s: S, d: str) -> DataFrame:
    """P08"""
    c = _categorised(s, d).withColumn("locus_ok", F.coalesce(F.contains("v_call", "chain"), F.lit(False)))
    return rounded(primers.mapping_rates(c, ["sample_key", "chain"]))


# --- lineage --------------------------------------------------------------------------------

_ANN = "ann as (select distinct ordinal, sample_key, chain, sequence_id, v_call, locus, filter_reason from annotations where deleted_at is null)"


def _annotations(s: S, d: str) -> DataFrame:
    return table(s, d, "annotations").filter("deleted_at is null").select("ordinal", "sample_key", "chain", "sequence_id", "v_call", "locus", "filter_reason").distinct()


@query(f"""with {obs_sql('sample_key', 'chain', 'mapping_sequence_id')}, {_ANN}, r as (select sample_key, chain, sequence_id, count(*) as n, arg_min(v_call, ordinal) as v from ann group by 1, 2, 3)
  select id, coalesce(n, 0) as n_matches, case when n = 1 then v end as v_call from obs left join r on obs.sample_key = r.sample_key and obs.chain = r.chain and mapping_sequence_id = sequence_id""")
def lineage_links(s: S, d: str) -> DataFrame:
    """J02, J03, R16"""
    o = roles.observations(s, d, "sample_key", "chain", "mapping_sequence_id")
    x = lineage.unique_join(o, _annotations(s, d), ["sample_key", "chain", "mapping_sequence_id"], ["sample_key", "chain", "sequence_id"], "ordinal", ["v_call"])
    return x.select("id", "n_matches", "v_call")


@query(f"""with q as (select distinct id, sample_key, chain, mapping_sequence_id as sequence_id from observations where mapping_sequence_id is not null and trim(mapping_sequence_id, ' ' || chr(9)) <> ''), {_ANN},
  own as (select sample_key, chain, sequence_id, count(*) as n from q group by 1, 2, 3), r as (select sample_key, chain, sequence_id, count(*) as n, arg_min(filter_reason, ordinal) as f from ann group by 1, 2, 3)
  select q.id, case when coalesce(own.n, 0) <> 1 then 'ambiguous_lineage' when r.n is null then 'missing_airr_row' when r.n > 1 then 'duplicate_airr_rows' else r.f end as filter_reason
  from q left join own using (sample_key, chain, sequence_id) left join r using (sample_key, chain, sequence_id)""")
def lineage_reasons(s: S, d: str) -> DataFrame:
    """J01, F34"""
    q = roles.observations(s, d, "sample_key", "chain", F.col("mapping_sequence_id").alias("sequence_id")).filter("sequence_id is not null and trim(BOTH ' \t' FROM sequence_id) <> ''")
    return lineage.mapping_lineage(q, _annotations(s, d), ["sample_key", "chain", "sequence_id"], "ordinal", ["v_call", "locus"]).select("id", "filter_reason")


_STAGES = ("raw_R1", "raw_R2", "fastp_R1", "fastp_R2", "clean_R1", "clean_R2")


@query("""with o as (select distinct id, sequence_id as c, mapping_sequence_id, sample, primers, j_call, sequence, v_call, pair from observations where sequence_id is not null), reads as (
  select 'raw_R1' as stage, c from o union all select 'raw_R2', c from o where pair is not null union all select 'fastp_R1', c from o where sequence <> '' union all select 'fastp_R2', c from o where sequence <> '' and v_call is not null
  union all select 'clean_R1', c from o where sequence <> '' and j_call is not null union all select 'clean_R2', c from o where sequence <> '' and j_call is not null and v_call is not null),
  n as (select c, """ + ", ".join(f"count(*) filter (where stage = '{x}') as {x.lower()}" for x in _STAGES) + """ from reads group by 1),
  q as (select c, count(*) as q, min(mapping_sequence_id) as sid from o where mapping_sequence_id is not null group by 1), a as (select sequence_id as sid, count(*) as a, min(filter_reason) as f from (select distinct ordinal, sequence_id, filter_reason from annotations) group by 1)
  select o.c as canonical, case when raw_r1 <> 1 or greatest(raw_r1, raw_r2, fastp_r1, fastp_r2, clean_r1, clean_r2) > 1 or coalesce(q, 0) > 1 then 'ambiguous_lineage' when raw_r2 <> 1 then 'pair_identity_unverified' when fastp_r1 <> fastp_r2 then 'pair_identity_unverified' when clean_r1 <> clean_r2 then 'pair_identity_unverified'
  when fastp_r1 = 0 then 'not_seen_after_fastp' when clean_r1 = 0 then 'clean_membership_unavailable' when q is null then 'not_merged' when a is null then 'missing_airr_row' when a > 1 then 'duplicate_airr_rows' else f end as filter_reason
  from o join n using (c) left join q using (c) left join a using (sid)""")
def raw_lineage_ladder(s: S, d: str) -> DataFrame:
    """A read is gone from a stage where the table lacks what the stage would give it"""
    o = table(s, d, "observations").select("id", "sequence_id", "mapping_sequence_id", "sample", "primers", "j_call", "sequence", "v_call", "pair").filter("sequence_id is not null").distinct()
    trimmed, clean, mate = F.col("sequence") != "", F.col("j_call").isNotNull(), F.col("v_call").isNotNull()
    rule = {"raw_R1": F.lit(True), "raw_R2": F.col("pair").isNotNull(), "fastp_R1": trimmed, "fastp_R2": trimmed & mate, "clean_R1": trimmed & clean, "clean_R2": trimmed & clean & mate}
    reads = o.select(F.col("sequence_id").alias("canonical"), F.explode(F.array(*(F.when(c, F.lit(n)) for n, c in rule.items()))).alias("stage")).filter("stage is not null")
    q = o.filter("mapping_sequence_id is not null").select(F.col("sequence_id").alias("canonical"), F.col("mapping_sequence_id").alias("sequence_id"))
    a = table(s, d, "annotations").select("ordinal", "sequence_id", "filter_reason").distinct()
    return lineage.raw_lineage(reads, q, a)


_OBS_COLS = ("sample_key", "chain", "scope", "match_class", "sample_match_class", "matching_source", "matching_ordinal", "matching_unit", "filter_reason", "trim_state", "v_call", "j_call", "c_call", "primers")


@query(f"""with {obs_sql(*_OBS_COLS)}, u as (select sample_key, matching_source, matching_ordinal, case when min(scope) is not distinct from max(scope) then min(scope) else 'mixed_annotation_evidence' end as scope,
  case when min(sample_match_class) is not distinct from max(sample_match_class) then min(sample_match_class) else 'conflicting_assessment' end as match_class, min(matching_unit) as unit, array_to_string(list_sort(list_distinct(list(chain))), ',') as chains from obs group by 1, 2, 3)
  select sample_key, scope, unit, chains, match_class, count(*) as count from u group by all""")
def matching_totals_dedup(s: S, d: str) -> DataFrame:
    """A14"""
    return lineage.matching_totals(roles.observations(s, d, *_OBS_COLS))


@query(f"""with {obs_sql(*_OBS_COLS)}, l as (select sample_key, chain, scope, unnest(['match_class', 'filter_reason', 'trim_state']) as counter, unnest([match_class, filter_reason, coalesce(nullif(trim_state, ''), 'not_recorded')]) as value from obs)
  select sample_key, chain, scope, counter, value, count(*) as count from l group by all""")
def observation_counters(s: S, d: str) -> DataFrame:
    """A12"""
    return lineage.counters(roles.observations(s, d, *_OBS_COLS), ["sample_key", "chain", "scope"])


@query(f"""with {obs_sql(*_OBS_COLS)}, c as (select sample_key, match_class as value, count(*) as n from obs group by 1, 2), k as (select sample_key, unnest(['unique', 'multiple', 'unmatched']) as value from (select distinct sample_key from c) union select sample_key, value from c)
  select k.sample_key, k.value, coalesce(n, 0) as count from k left join c on c.sample_key is not distinct from k.sample_key and c.value is not distinct from k.value""")
def densified_counts(s: S, d: str) -> DataFrame:
    """A13"""
    c = roles.observations(s, d, *_OBS_COLS).groupBy("sample_key", F.col("match_class").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return lineage.densify(c, ["sample_key"], "value", ["unique", "multiple", "unmatched"])


_SEG = f"""{obs_sql(*_OBS_COLS)}, sub as (select *, unnest(case when filter_reason in ('retained', 'retained_history', 'imported_result') then ['all', 'retained'] else ['all'] end) as subset from obs),
  seg as (select sample_key, chain, subset, 'V' as segment, {C.sql_calls('v_call')} as g from sub union all select sample_key, chain, subset, 'J', {C.sql_calls('j_call')} from sub union all select sample_key, chain, subset, 'C', {C.sql_calls('c_call')} from sub)"""


@query(f"""with {_SEG}, c as (select sample_key, chain, subset, segment, case when len(g) = 1 then g[1] when len(g) > 1 then '[Multiple]' else '[None]' end as gene, count(*) as count from seg group by all)
  select *, cast(sum(count) over p as bigint) as denominator, round(cast(100 as double) * count / sum(count) over p, 6) as percent from c window p as (partition by sample_key, chain, subset, segment)""")
def gene_observations(s: S, d: str) -> DataFrame:
    """A16, F36"""
    return rounded(lineage.gene_observations(roles.observations(s, d, *_OBS_COLS), ["sample_key", "chain"]))


@query(f"""with {_SEG}, e as (select sample_key, chain, subset, segment, len(g) = 1 as one, unnest(g) as gene from seg) select sample_key, chain, subset, segment, gene, count(*) filter (where one) as unique_count, count(*) filter (where not one) as ambiguous_count, 'observed' as status from e group by all""")
def reference_coverage(s: S, d: str) -> DataFrame:
    """A17"""
    return lineage.gene_coverage(roles.observations(s, d, *_OBS_COLS), ["sample_key", "chain"])


@query(f"with {obs_sql(*_OBS_COLS)} select sample_key, chain from obs group by 1, 2 having min(scope) <> max(scope)")
def mixed_evidence(s: S, d: str) -> DataFrame:
    """V07"""
    return lineage.mixed_evidence(roles.observations(s, d, *_OBS_COLS))


@query(f"with {obs_sql(*_OBS_COLS)} select id from obs where list_contains({C.sql_calls('v_call')}, 'IGHV5-190') and filter_reason in ('retained', 'retained_history')")
def observation_selection(s: S, d: str) -> DataFrame:
    """F33, U01, J13"""
    return lineage.observation_filter(roles.observations(s, d, *_OBS_COLS), gene="IGHV5-190", reasons=["retained", "retained_history"]).select("id")


@query("""with a as (select o_orderkey as o, o_custkey as k from orders where o_orderstatus <> 'P'), b as (select l_orderkey as o, case when max(l_returnflag) = 'R' then -1 else any_value(o_custkey) end as k from lineitem join orders on l_orderkey = o_orderkey group by 1 having min(l_linestatus) = 'F')
  select coalesce(a.o, b.o) as ordinal, a.k as r1_key, b.k as r2_key, case when a.o is null then 'missing_r1' when b.o is null then 'missing_r2' when a.k = b.k then 'paired' else 'key_mismatch' end as state from a full join b on a.o = b.o""")
def pair_join_verified(s: S, d: str) -> DataFrame:
    """The ends of a pair are an order that is not pending, and its delivered lines; lines sent back bear another key"""
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("ordinal"), F.col("o_custkey").alias("k"), "o_orderstatus")
    l = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_returnflag").alias("back"), F.min("l_linestatus").alias("sent")).filter("sent = 'F'")
    r2 = l.join(o, F.col("l_orderkey") == F.col("ordinal")).select("ordinal", F.when(F.col("back") == "R", -1).otherwise(F.col("k")).alias("k"))
    return umi.pair_reads(o.filter("o_orderstatus <> 'P'").select("ordinal", "k"), r2, ["ordinal"], "k")


# --- stages ---------------------------------------------------------------------------------


def _stage_rows(s: S, d: str) -> tuple[DataFrame, DataFrame]:
    """Stage counts of 'pairs' made from orders: one pair per customer nation digit and priority."""
    o = table(s, d, "orders").selectExpr("o_orderpriority as sample", "concat('P', o_custkey % 5) as pair", "cast(o_totalprice as bigint) as v")
    g = o.groupBy("sample", "pair").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("m"))
    counts = {"raw_r1": "n * 4", "raw_r2": "n * 4", "fastp_r1": "n * 3", "fastp_r2": "n * 3", "clean": "n * 6 - 1", "merge_input": "n * 3", "merged": "case when pair = 'P3' and sample like '1%' then null else n * 2 end"}
    rows = g.select("sample", "pair", F.explode(F.array(*(F.struct(F.lit(k).alias("stage"), F.expr(e).cast("bigint").alias("count")) for k, e in counts.items()))).alias("x")).select("sample", "pair", "x.stage", F.lit("").alias("chain"), "x.count")
    return rows, g.select("sample", "pair")


_STAGE_SQL = """with g as (select o_orderpriority as sample, 'P' || (o_custkey % 5) as pair, count(*) as n from orders group by 1, 2), t as (select sample, sum(n) * 4 as raw_r1, sum(n) * 4 as raw_r2, sum(n) * 3 as fastp_r1, sum(n) * 3 as fastp_r2, sum(n * 6 - 1) as clean, sum(n) * 3 as merge_input,
  case when sample like '1%' and count(*) filter (where pair = 'P3') > 0 then null else sum(n) * 2 end as merged from g group by 1),
  v as (select *, raw_r1 + raw_r2 as raw, fastp_r1 + fastp_r2 as fastp from t),
  u as (""" + " union all ".join(f"select sample, {i} as position, '{st}' as stage, '{stages.UNITS[st]}' as unit, {st} as count, '{b or ''}' as previous_stage, {b or 'null'} as previous_count, {'true' if b and (m or stages.UNITS[b] == stages.UNITS[st]) else 'false'} as ok from v" for i, (st, b, m) in enumerate(stages.STAGES)) + """)
  select sample, cast(position as int) as position, stage, unit, cast(count as bigint) as count, previous_stage, cast(previous_count as bigint) as previous_count, cast(case when ok then previous_count - count end as bigint) as reduction, case when ok and previous_count <> 0 then round(cast(100 as double) * count / previous_count, 6) end as retention_percent from u"""


@query(_STAGE_SQL)
def stage_volume(s: S, d: str) -> DataFrame:
    """A30, J18, S18"""
    rows, pairs = _stage_rows(s, d)
    return rounded(stages.stage_volumes(stages.stage_totals(rows, pairs)))


@query("with x as (" + _STAGE_SQL + """) select sample, stage, round(cast(100 as double) * count / max(count) over (partition by sample), 6) as of_max_percent, count - lag(count) over (partition by sample order by position) as change from x where count is not null""")
def stage_matrix(s: S, d: str) -> DataFrame:
    """A44"""
    rows, pairs = _stage_rows(s, d)
    v = stages.stage_volumes(stages.stage_totals(rows, pairs)).withColumn("chain", F.lit(""))
    return rounded(stages.stage_matrix(v).select("sample", "stage", "of_max_percent", "change"))


@query(f"""with {AIRR_SQL}, p as (select distinct o_orderstatus as sample, 'P' || (o_custkey % 3) as pair, count(*) over (partition by o_orderstatus, o_custkey % 3) as c from orders), i as (select distinct sample, locus as chain from airr), t as (select i.sample, chain, sum(case when sample = 'P' and pair = 'P1' then null else c end) as s, count(case when sample = 'P' and pair = 'P1' then null else c end) as k, count(*) as n from i join p using (sample) group by 1, 2),
  m as (select sample, locus as chain, sum(umi_counts) as u, count(distinct cdr3_aa) as x from airr where locus <> 'TRG' group by 1, 2), j as (select t.*, case when k = n then s end as r, u, x from t left join m using (sample, chain))
  select sample, chain, cast(r as bigint) as total_reads, cast(u as bigint) as total_receptor_rna, x as total_unique_cdr3s, case when r is not null and u is not null then 'complete' when r is not null or u is not null then 'partial' else 'unavailable' end as status,
  array_to_string(list_filter([case when r is null then 'Merged count unavailable' end, case when u is null then 'AIRR preprocessing unavailable' end], lambda z: z is not null), '; ') as note from j""")
def sample_outputs_guarded(s: S, d: str) -> DataFrame:
    """A28, A29"""
    a = roles.airr(s, d)
    pairs = table(s, d, "orders").selectExpr("o_orderstatus as sample", "concat('P', o_custkey % 3) as pair").groupBy("sample", "pair").agg(F.count(F.lit(1)).alias("count"))
    items = a.select("sample", F.col("locus").alias("chain")).distinct().join(pairs.select("sample", "pair"), "sample")
    merged = pairs.withColumn("count", F.expr("case when sample = 'P' and pair = 'P1' then null else count end"))
    per = a.filter("locus <> 'TRG'").groupBy("sample", F.col("locus").alias("chain"), "cdr3_aa").agg(F.sum("umi_counts").alias("u")).groupBy("sample", "chain").agg(F.sum("u").alias("umi_counts"), F.count("cdr3_aa").alias("unique_cdr3"))
    return stages.sample_outputs(items, merged, per)


@query("""select * from (values ('S1', 100, 80, '80.00', false), ('S2', 50, 25, '50.00', true)) t(sample_id, input_pairs, merged_sequences, merge_percent, repaired)""".replace("100, 80", "cast(100 as bigint), cast(80 as bigint)").replace("50, 25", "cast(50 as bigint), cast(25 as bigint)"))
def legacy_record_repair(s: S, d: str) -> DataFrame:
    """S19"""
    rows = [("f", 1, "S1", "p1", "100", "80", "80.00", "OK", ""), ("f", 2, "S2", "p2", "50", "25", "OK", "", ""), ("f", 3, "50.00", "", "", "", "OK", "", ""), ("f", 4, "S3", "p3", "10", "9", "OK", "", ""), ("f", 5, "12.00", "", "", "", "OK", "", ""), ("f", 6, "S4", "p4", "5", "5", "", "ERROR", "x")]
    t = s.createDataFrame(rows, "file string, line int, sample_id string, pair_id string, input_pairs string, merged_sequences string, merge_percent string, status string, error string")
    return stages.legacy_merge_records(t, "file", "line").drop("file", "pair_id")


@query("""with j as (select distinct id, pipeline, status, attempt_no from jobs), g as (select pipeline, cast(sum(attempt_no) as bigint) as input_sequences, count(*) filter (where status = 'SUCCEEDED') as mapped_rows, min(case when status = 'FAILED' then 0 when status = 'SUCCEEDED' then 1 else 2 end) as st, count(*) as batches from j group by 1)
  select pipeline, input_sequences, cast(mapped_rows as bigint) as mapped_rows, batches, case st when 0 then 'ERROR' when 1 then 'OK' else 'EMPTY' end as status, round(cast(100 as double) * mapped_rows / input_sequences, 2) as mapped_percent from g""")
def summary_roll_up(s: S, d: str) -> DataFrame:
    """A36"""
    j = table(s, d, "jobs").select("id", "pipeline", "status", "attempt_no").distinct()
    st = F.when(F.col("status") == "FAILED", "ERROR").when(F.col("status") == "SUCCEEDED", "OK").otherwise("EMPTY")
    return stages.summary_roll_up(j.select("pipeline", F.col("attempt_no").alias("input_sequences"), (F.col("status") == "SUCCEEDED").cast("bigint").alias("mapped_rows"), st.alias("status")), ["pipeline"])


@query("""with j as (select distinct id, pipeline, status from jobs) select pipeline, count(*) as total, count(*) filter (where status = 'SUCCEEDED') as succeeded, count(*) filter (where status = 'FAILED') as failed, count(*) filter (where status = 'STOPPED') as stopped from j group by 1""")
def job_counters(s: S, d: str) -> DataFrame:
    """A37, A39"""
    j = table(s, d, "jobs").select("id", "pipeline", "status").distinct()
    out = stages.status_counts(j, ["pipeline"], ["SUCCEEDED", "FAILED", "STOPPED"])
    return out.select("pipeline", "total", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("succeeded", "failed", "stopped")))


@query("""with j as (select distinct id, pipeline, dataset, coalesce(attempt_no, 0) as a from jobs where pipeline is not null), m as (select *, max(a) over (partition by pipeline) as mx from j) select pipeline, case when min(dataset) = max(dataset) and count(dataset) = count(*) then min(dataset) end as dataset, max(a) as a from m where a = mx group by 1""")
def best_evidence(s: S, d: str) -> DataFrame:
    """R17"""
    j = table(s, d, "jobs").select("id", "pipeline", "dataset", F.coalesce("attempt_no", F.lit(0)).alias("a")).filter("pipeline is not null").distinct()
    return stages.best_evidence(j, ["pipeline"], "a", "dataset")


# --- matching, paging, exports ----------------------------------------------------------------

@query("""with r as (select distinct left(id, 8) as sid from derived_runs where id is not null and output_root is not null), f as (select distinct output_root as path, string_split(output_root, '/')[-1] as sid from derived_runs where output_root is not null)
  select path, f.sid as record_id, 'sample_id' as match_method, '' as error from f join r using (sid) union all select path, null, 'error', 'no dual index matches' from f where not exists (select 1 from r where r.sid = f.sid)""")
def path_containment_match(s: S, d: str) -> DataFrame:
    """The paths hold the first 8 digits of a run's id, between bounds"""
    t = table(s, d, "derived_runs").filter("output_root is not null")
    rec = t.filter("id is not null").select(F.substring("id", 1, 8).alias("record_id")).distinct().select("record_id", F.lit("/srv/derived").alias("note"), F.col("record_id").alias("sample_id"), F.lit("").alias("dual_index"))
    return matching.match_files(t.select(F.col("output_root").alias("path")), rec)


@query("""select * from (values ('7C', 'TRA,TRB,TRD,TRG,IGH,IGK,IGL', 'IGH,IGK,IGL,TRA,TRB,TRD,TRG'), ('t+igk', 'TRA,TRB,TRD,TRG,IGK', 'TRA,TRB,TRD,TRG,IGK'), ('IGH*', 'IGHA,IGHD,IGHE,IGHG,IGHM', 'IGH'), ('IGHG;TRB', 'IGHG,TRB', 'IGH,TRB'), ('XYZ', null, null), ('', null, null)) t(selector, audit, db)""")
def chain_selectors(s: S, d: str) -> DataFrame:
    """F28"""
    t = s.createDataFrame([(x,) for x in ("7C", "t+igk", "IGH*", "IGHG;TRB", "XYZ", "")], "selector string").withColumn("e", matching.expand_chains("selector"))
    return t.select("selector", F.array_join("e.audit", ",").alias("audit"), F.array_join("e.database", ",").alias("db"))


@query("""with j as (select distinct id, dataset from jobs where id is not null), r as (select distinct lower(trim(parent_job_id, ' ' || chr(9) || chr(10))) as id from derived_runs where parent_job_id is not null) select r.id from r where not exists (select 1 from j where j.id = r.id)""")
def missing_tasks(s: S, d: str) -> DataFrame:
    """J20, J22, X04"""
    r = table(s, d, "derived_runs").filter("parent_job_id is not null").select(F.expr("lower(trim(BOTH ' \t\n' FROM parent_job_id))").alias("id"))
    return matching.missing_tasks(r, table(s, d, "jobs").filter("id is not null"), ["id"])


@query("with o as (select distinct matching_source, scope from observations where matching_source is not null and scope is not null) select matching_source from o group by 1 having count(*) > 1")
def shared_sources(s: S, d: str) -> DataFrame:
    """J21"""
    return matching.shared_sources(table(s, d, "observations").filter("matching_source is not null and scope is not null"), "matching_source", "scope")


@query("select user_id, case when min(f) <> max(f) then 'mixed' when min(f) = 1 then 'raw' else 'presplit' end as mode from (select user_id, case when event_type = 'click' then 1 else 0 end as f, row_number() over (partition by user_id order by event_id) as rn from events) where rn <= 4 group by 1")
def input_mode(s: S, d: str) -> DataFrame:
    """F26"""
    e = table(s, d, "events").withColumn("raw", F.col("event_type") == "click")
    return matching.input_mode(e, "user_id", "event_id", "raw", 4)


@query("""with a as (select id, 'ds/' || string_split(output_root, '/')[-2] || '/' || string_split(output_root, '/')[-1] as w, output_root as p from (select distinct id, output_root from derived_runs where output_root is not null and id is not null)),
  k as (select string_split(p, '/')[-2] || '/' || string_split(p, '/')[-1] as t, count(*) as n, min(p) as p from (select distinct p from a) group by 1) select a.id, case when n = 1 then k.p end as path, cast(case when n = 1 then 2 end as int) as score from a join k on k.t = string_split(a.p, '/')[-2] || '/' || string_split(a.p, '/')[-1]""")
def best_suffix(s: S, d: str) -> DataFrame:
    """J17"""
    t = table(s, d, "derived_runs").filter("output_root is not null and id is not null").select("id", "output_root").distinct()
    w = t.withColumn("wanted", F.concat(F.lit("ds/"), F.element_at(F.split("output_root", "/"), -2), F.lit("/"), F.element_at(F.split("output_root", "/"), -1)))
    return matching.best_suffix(w, t, "id", "wanted", "output_root").select("id", "path", F.col("score").cast("int").alias("score"))


@query("with o as (select distinct id, sample_key from observations) select id, sample_key, true as has_more from o where id > 100 order by id limit 50")
def keyset_page(s: S, d: str) -> DataFrame:
    """L05, L06"""
    return ranking.keyset_page(roles.observations(s, d, "sample_key"), "id", 100, 50)


@query("with o as (select distinct id, sample_key from observations) select * from o order by id offset 40 limit 30")
def offset_page(s: S, d: str) -> DataFrame:
    """L04"""
    return ranking.offset_page(roles.observations(s, d, "sample_key"), [F.col("id").asc()], 40, 30)


@query("with j as (select distinct id, pipeline, last_error from jobs) select id from j where contains(lower(concat_ws(' ', coalesce(id, ''), coalesce(pipeline, ''), coalesce(last_error, ''))), 'incomplete')")
def search_page(s: S, d: str) -> DataFrame:
    """F31"""
    return ranking.search(table(s, d, "jobs").select("id", "pipeline", "last_error").distinct(), "InComplete").select("id")


@query("with g as (select distinct gene from composition_calls where gene <> '') select gene, cast(floor((row_number() over (order by gene) - 1) / 25) as bigint) as page from g")
def figure_pages(s: S, d: str) -> DataFrame:
    """L07"""
    return ranking.page_number(table(s, d, "composition_calls").filter("gene <> ''").select("gene").distinct(), [], [F.col("gene").asc()], 25)


@query("select distinct sample, chain, cast(list_position(['IGH', 'IGK', 'IGL', 'TRA', 'TRB', 'TRD', 'TRG'], chain) - 1 as int) as position from observations where sample is not null and chain is not null")
def sample_chain_order(s: S, d: str) -> DataFrame:
    """L01, A42"""
    return table(s, d, "observations").filter("sample is not null and chain is not null").select("sample", "chain").distinct().withColumn("position", (F.array_position(F.array(*(F.lit(c) for c in ("IGH", "IGK", "IGL", "TRA", "TRB", "TRD", "TRG"))), F.col("chain")) - 1).cast("int"))


@query("""with o as (select distinct sample, chain, sample_key from observations where sample is not null) select sample, array_to_string(list_sort(list_distinct(list(chain))), ';') as chains, min(sample_key) as anchor,
  case when bool_or(chain = 'IGH') then 'Heavy' when bool_or(chain in ('IGK', 'IGL')) then 'Light' else 'TCR' end as category from o group by 1""")
def sample_overview(s: S, d: str) -> DataFrame:
    """A43"""
    o = table(s, d, "observations").filter("sample is not null").groupBy("sample").agg(F.array_join(F.array_sort(F.collect_set("chain")), ";").alias("chains"), F.min("sample_key").alias("anchor"), F.max(F.col("chain") == "IGH").alias("_h"), F.max(F.col("chain").isin("IGK", "IGL")).alias("_l"))
    return o.withColumn("category", F.when(F.col("_h"), "Heavy").when(F.col("_l"), "Light").otherwise("TCR")).drop("_h", "_l")


@query(f"""with {AIRR_SQL}, a as (select distinct sample, cdr3_aa from airr where locus = 'IGH' and cdr3_aa is not null), b as (select distinct sample, cdr3_aa from airr where locus = 'TRB' and cdr3_aa is not null)
  select 'union' as op, count(*) as n from (select * from a union select * from b) union all select 'union_all', (select count(*) from a) + (select count(*) from b) union all select 'intersect', count(*) from (select * from a intersect select * from b) union all select 'except', count(*) from (select * from a except select * from b)""")
def set_ops(s: S, d: str) -> DataFrame:
    """X01-X04, X07"""
    a, b = (roles.airr(s, d).filter(F.col("locus") == x).filter("cdr3_aa is not null").select("sample", "cdr3_aa").distinct() for x in ("IGH", "TRB"))
    n = lambda df, op: df.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n")
    return n(a.union(b).distinct(), "union").unionByName(n(a.union(b), "union_all")).unionByName(n(a.intersect(b), "intersect")).unionByName(n(a.subtract(b), "except"))


@query("""with d as (select doc_id, text from documents) select doc_id, case when regexp_matches(text, '^[=+\\-@]') then '''' || text else text end as text from d""")
def csv_guard(s: S, d: str) -> DataFrame:
    """K01"""
    return sinks.export_table(table(s, d, "documents"), ["doc_id", "text"])


@query("select doc_id, case when isfinite(cast(n_chars as double)) then cast(n_chars as double) end as value from documents")
def chart_table(s: S, d: str) -> DataFrame:
    """K11, F21"""
    return sinks.chart_table(table(s, d, "documents").select("doc_id", F.col("n_chars").alias("value"), "lang"), ["doc_id", "value"])


@query("""with p as (select distinct sample_key, chain, primers as grp from observations where match_class = 'unique' and primers is not null), w as (select distinct sample_key, chain, 'all' as grp from observations)
  select * from p union select * from w where not exists (select 1 from p where p.sample_key = w.sample_key and p.chain = w.chain)""")
def covered_export(s: S, d: str) -> DataFrame:
    """K16"""
    o = table(s, d, "observations")
    p = o.filter("match_class = 'unique' and primers is not null").select("sample_key", "chain", F.col("primers").alias("grp")).distinct()
    return sinks.covered_export(p, o.select("sample_key", "chain", F.lit("all").alias("grp")).distinct(), ["sample_key", "chain"])


@query("with o as (select distinct id, sample_key, sequence from observations where sequence is not null and filter_reason = 'retained') select '>' || id || chr(10) || sequence as value from o")
def record_fasta(s: S, d: str) -> DataFrame:
    """K06, K12"""
    o = roles.observations(s, d, "sample_key", "sequence", "filter_reason").filter("sequence is not null and filter_reason = 'retained'")
    return o.select(sinks.fasta(F.col("id").cast("string"), "sequence").alias("value"))


@query("with j as (select distinct id from jobs where id is not null) select id, regexp_replace(id, '[^A-Za-z0-9._-]+', '_', 'g') || '_' || left(sha256(id), 12) as slug from j")
def path_slugs(s: S, d: str) -> DataFrame:
    """F30, V08, Y03"""
    return table(s, d, "jobs").select("id").filter("id is not null").distinct().withColumn("slug", H.slug("id"))


@query("select count(*) as n, count(*) filter (where k > 1) as repeated from (select id, count(*) as k from jobs where id is not null group by 1)")
def duplicate_guard(s: S, d: str) -> DataFrame:
    """V06"""
    j = stages.duplicates_as_errors(table(s, d, "jobs").filter("id is not null").withColumn("error", F.lit(None).cast("string")), ["id"], ["loaded_at"])
    per = j.groupBy("id").agg(F.max((F.col("error").isNotNull()).cast("int")).alias("e"))
    return per.agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("repeated"))


@query("select id, json_extract_string(data_json, '$.metric') as metric, cast(json_extract_string(data_json, '$.items') as bigint) as items from (select distinct id, data_json from derived_runs)")
def run_facts(s: S, d: str) -> DataFrame:
    """Y07"""
    return table(s, d, "derived_runs").select("id", "data_json").distinct().select("id", F.get_json_object("data_json", "$.metric").alias("metric"), F.expr("try_cast(get_json_object(data_json, '$.items') as bigint)").alias("items"))


@query("with g as (select group_id, sum(weight) as w from (select distinct id, group_id, weight from composition_records) group by 1) select group_id, cast(w as bigint) as copies, case when sum(w) over () <> 0 then round(cast(100 as double) * w / (select sum(w) from g), 6) end as percent from g")
def group_shares(s: S, d: str) -> DataFrame:
    """A38, Y09"""
    g = roles.records(s, d).select("id", "group_id", "weight").distinct().groupBy("group_id").agg(F.sum("weight").alias("copies"))
    return rounded(g.withColumn("percent", pct(F.col("copies"), g.agg(F.sum("copies")).scalar())))


@query("""with j as (select distinct id, created_at, ended_at from jobs), t as (select id, try_cast(replace(created_at, 'Z', '+00:00') as timestamptz) as a, try_cast(replace(ended_at, 'Z', '+00:00') as timestamptz) as b,
  try_cast(created_at as timestamp) as c, try_cast(ended_at as timestamp) as d, regexp_matches(created_at, '(Z|[+-][0-9][0-9]:?[0-9][0-9])$') as za, regexp_matches(ended_at, '(Z|[+-][0-9][0-9]:?[0-9][0-9])$') as zb from j),
  u as (select id, case when za then timezone('UTC', a) else c end as s, case when zb then timezone('UTC', b) else d end as e from t) select id, strftime(s, '%Y-%m-%d %H:%M:%S') as started, cast(date_diff('second', s, e) as bigint) as seconds from u""")
def job_durations(s: S, d: str) -> DataFrame:
    """Text times in several forms, as UTC"""
    j = table(s, d, "jobs").select("id", "created_at", "ended_at").distinct().select("id", utc_time("created_at").alias("a"), utc_time("ended_at").alias("b"))
    return j.select("id", F.date_format("a", "yyyy-MM-dd HH:mm:ss").alias("started"), F.timestamp_diff("SECOND", "a", "b").alias("seconds"))


@query("""with r as (select distinct id, weight from composition_records where weight > 0 and sample_record = 1) select id, weight, cast(row_number() over (order by weight desc, id) + 99 as bigint) as new_id from r""")
def sequential_ids(s: S, d: str) -> DataFrame:
    """R15"""
    r = table(s, d, "composition_records").filter("weight > 0 and sample_record = 1").select("id", "weight").distinct()
    return ranking.sequential_ids(r, [F.desc("weight"), F.asc("id")], 100)


@query("""select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_returnflag, l_linestatus, row_number() over w as rank, cast(sum(cast(l_quantity as bigint)) over (w rows unbounded preceding) as bigint) as running, cast(sum(cast(l_quantity as bigint)) over (partition by l_returnflag) as bigint) as whole
  from lineitem window w as (partition by l_returnflag order by l_extendedprice desc, l_orderkey, l_linenumber)""")
def line_ranks(s: S, d: str) -> DataFrame:
    """Ranks and running sums within three large groups, with columns that take no part"""
    l = table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")
    l = l.withColumn("q", F.col("l_quantity").cast("bigint"))
    return ranking.running(l, ["l_returnflag"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], "q", whole="whole").drop("q")


@query("""with g as (select sample_key, match_class, count(*) as n from observations where sample_key is not null group by 1, 2) select sample_key, match_class, n from g""")
def counter_upserts(s: S, d: str) -> DataFrame:
    """The counts of the last month added to the older ones"""
    o = table(s, d, "observations").filter("sample_key is not null")
    late = F.col("loaded_at") >= o.agg(F.max("loaded_at") - F.expr("interval 30 day")).scalar()
    part = lambda c: o.filter(c).groupBy("sample_key", "match_class").agg(F.count(F.lit(1)).alias("n"))
    return ranking.add_counts(part(~F.coalesce(late, F.lit(False))), part(late), ["sample_key", "match_class"])


@query("with o as (select distinct sequence from observations) select sequence, coalesce(regexp_matches(upper(sequence), '^[ACGT]+$'), false) as plain, coalesce(regexp_matches(upper(sequence), '^[ACGTRYSWKMBDHVNU]+$'), false) as iupac from o")
def sequence_validity(s: S, d: str) -> DataFrame:
    """Y10"""
    return table(s, d, "observations").select("sequence").distinct().select("sequence", valid_sequence("sequence", "acgt").alias("plain"), valid_sequence("sequence").alias("iupac"))


# --- event windows (extension) ------------------------------------------------------------------


@query("select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M:%S') as window_start, event_type, count(*) as events, round(sum(value), 6) as value_sum from events group by 1, 2")
def events_tumbling(s: S, d: str) -> DataFrame:
    """Extension: hourly windows"""
    t = windows.tumbling(table(s, d, "events"))
    return rounded(t.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")))


@query("""with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as n from events), g as (select user_id, ts, sum(n) over (partition by user_id order by ts rows unbounded preceding) as k from e)
  select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as session_start, count(*) as events from g group by user_id, k""")
def events_sessions(s: S, d: str) -> DataFrame:
    """Extension: sessions of a user's events less than 30 minutes apart"""
    t = windows.sessions(table(s, d, "events"))
    return t.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "events")


