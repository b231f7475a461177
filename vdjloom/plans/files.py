"""Queries of sources, sinks, receipts and checkpoints: whole tables are written as files to the shared folder, read back by the
operator, and compared with SQL on the tables."""

from __future__ import annotations

import json
import unicodedata

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vdjloom.functions import calls as C
from vdjloom.functions import headers as H
from vdjloom.functions import values as V
from vdjloom.functions.text import sql_text
from vdjloom.operators import clones, evidence, filters, lineage, matching, primers, stages
from vdjloom.plans import composition, repertoire, roles
from vdjloom.plans.durable import new_path
from vdjloom.plans.repertoire import rounded
from vdjloom.plans.roles import AIRR_SQL, RECORDS_SQL
from vdjloom.sources import airr, discovery, inputs, sinks
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


def written(df: DataFrame, sep: str = ",", compression: str = "gzip", **kw) -> str:
    """The frame as CSV parts in a new place."""
    path = new_path(df.sparkSession)
    sinks.write_csv(df, path, sep=sep, compression=compression, **kw)
    return path


def lined(df: DataFrame, *head: str) -> str:
    """The frame as commented TSV parts in a new place."""
    path = new_path(df.sparkSession)
    sinks.write_lines(df, path, list(head))
    return path


# --- scans ------------------------------------------------------------------------------------

_JOB = ("id", "operator", "pipeline", "dataset", "output_root", "status", "current_stage", "last_error", "created_at", "ended_at")


@query(f"select {', '.join(_JOB)} from jobs")
def table_scan(s: S, d: str) -> DataFrame:
    """Texts with nulls, blanks, quotes and delimiters through CSV"""
    return airr.read_table(s, written(table(s, d, "jobs").select(*_JOB)))


@query("select doc_id, text from (select doc_id, case when regexp_matches(text, '^[=+\\-@]') then '''' || text else text end as text from documents)")
def table_scan_long_texts(s: S, d: str) -> DataFrame:
    """Texts with line ends and quotes, whole"""
    got = airr.read_table(s, written(table(s, d, "documents").select("doc_id", "text")), comment=None, lines_in_fields=True)
    return got.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")


@query("select sequence_id, locus, cast(null as varchar) as not_there from annotations")
def table_scan_selected(s: S, d: str) -> DataFrame:
    """Two columns of a TSV, and one that it lacks"""
    path = written(table(s, d, "annotations").select("source", "sequence_id", "locus", "v_call", "cdr3_aa"), sep="\t")
    return airr.read_table(s, path, ["sequence_id", "locus", "not_there"], required=["sequence_id"])


_READS = "with o as (select distinct id, chain, upper(sequence) as sequence from observations where sequence is not null and sequence <> '')"


def _fastq(s: S, d: str, compression: str) -> DataFrame:
    """Reads with a quality by base; those of TRG lack its last sign."""
    o = table(s, d, "observations").filter("sequence <> ''").select("id", "chain", F.upper("sequence").alias("sequence")).distinct()
    q = F.translate("sequence", "ACGTN", "IH5#!")
    q = F.when(F.col("chain") == "TRG", F.expr("left(q, length(q) - 1)")).otherwise(F.col("q"))
    o = o.withColumn("q", F.translate("sequence", "ACGTN", "IH5#!")).withColumn("q", q)
    path = new_path(s)
    o.select(F.concat(F.lit("@R"), "id", F.lit("/1 x\n"), F.lower("sequence"), F.lit("\n+\n"), "q").alias("value")).write.option("compression", compression).text(path)
    return airr.read_fastq(s, path, "raw_R1")


_FASTQ_SQL = _READS + """, q as (select id, sequence, case when chain = 'TRG' then left(translate(sequence, 'ACGTN', 'IH5#!'), length(sequence) - 1) else translate(sequence, 'ACGTN', 'IH5#!') end as q, chain from o)
  select 'R' || id || '/1 x' as title, 'R' || id as canonical, sequence, q as quality, coalesce(chain <> 'TRG', true) as valid from q"""


@query(_FASTQ_SQL)
def fastq_scan(s: S, d: str) -> DataFrame:
    """Compressed reads, streamed"""
    return _fastq(s, d, "gzip").select("title", "canonical", "sequence", "quality", "valid")


@query(_FASTQ_SQL)
def fastq_scan_plain(s: S, d: str) -> DataFrame:
    """Plain reads, in blocks"""
    return _fastq(s, d, "none").select("title", "canonical", "sequence", "quality", "valid")


@query(_READS + """, b as (select id, chain, unnest(string_split(case when chain = 'TRG' then left(translate(sequence, 'ACGTN', 'IH5#!'), length(sequence) - 1) else translate(sequence, 'ACGTN', 'IH5#!') end, '')) as x from o)
  select 'R' || id as canonical, round(avg(cast(ascii(x) - 33 as double)), 6) as mean_quality, round(sum(pow(10.0, -cast(ascii(x) - 33 as double) / 10)), 6) as expected_errors from b where x <> '' group by id, chain""")
def read_quality(s: S, d: str) -> DataFrame:
    """Mean Phred value and expected errors"""
    return rounded(_fastq(s, d, "gzip").select("canonical", "mean_quality", "expected_errors"))


@query(_READS + " select 'R' || id || ' ' || coalesce(chain, '') as title, sequence from o")
def fasta_scan(s: S, d: str) -> DataFrame:
    """Sequences over several lines"""
    o = table(s, d, "observations").filter("sequence <> ''").select("id", F.coalesce("chain", F.lit("")).alias("chain"), F.upper("sequence").alias("sequence")).distinct()
    path = new_path(s)
    sinks.write_text(o, sinks.fasta(F.concat(F.lit("R"), "id", F.lit(" "), "chain"), "sequence", 30), path)
    return airr.read_fasta(s, path).select("title", "sequence")


@query("select sequence_id, locus, v_call, v_identity from annotations where sequence_id is not null")
def airr_scan(s: S, d: str) -> DataFrame:
    """AIRR parts with comments before their header, blanks as nulls"""
    a = table(s, d, "annotations").filter("sequence_id is not null").select("sequence_id", "locus", "d_call", "v_call", "v_identity")
    return airr.read_airr(s, lined(a, "# made by a mapper", "#version\t1")).select("sequence_id", "locus", "v_call", "v_identity")


@query(f"with {AIRR_SQL} select barcode, locus, cast(case when locus = 'TRG' then 1 else umi_counts end as bigint) as umi_counts, '' as c_call from airr")
def droplet_scan(s: S, d: str) -> DataFrame:
    """umi_count stands for umi_counts, a missing count is 1, a missing column blank"""
    a = roles.airr(s, d).select(F.col("barcode").cast("string").alias("barcode"), "locus", F.when(F.col("locus") != "TRG", F.col("umi_counts")).alias("umi_count"), "v_score")
    return airr.read_droplet(s, written(a), ["barcode", "locus", "umi_counts", "c_call"]).withColumn("barcode", F.col("barcode").cast("bigint"))


@query(f"""with {AIRR_SQL} select sample, locus as chain, v_call, j_call, cdr3_aa, count(*) as record_count from airr where productive = 'T' and trim(cdr3_aa) <> '' group by all""")
def clone_scan(s: S, d: str) -> DataFrame:
    """Clones counted from a written table"""
    a = roles.airr(s, d).select(F.col("ordinal").cast("string").alias("sequence_id"), "sample", "locus", "productive", "v_call", "j_call", "cdr3_aa")
    return clones.clone_counts(airr.read_airr(s, lined(a)).withColumnRenamed("locus", "chain"), ["sample", "chain"])


@query(repertoire._REP + " select barcode, umi, sequence, total_reads from rep")
def state_scan(s: S, d: str) -> DataFrame:
    """Representatives from a compressed table"""
    r = repertoire._representatives(s, d).select("barcode", "umi", "sequence", "total_reads", "ambiguity")
    return airr.read_table(s, written(r, sep="\t"), ["barcode", "umi", "sequence", "total_reads"]).withColumns({"barcode": F.col("barcode").cast("bigint"), "total_reads": F.col("total_reads").cast("bigint")})


_CANONICAL = repertoire.ORACLE["canonical_header"].replace("select sequence_id, array_to_string", "select sequence_id as read_id, array_to_string")


@query(f"with c as ({_CANONICAL}), u as (select distinct sequence_id as read_id, upper(left(sequence, 10)) as umi from observations where sequence_id is not null and length(sequence) >= 10) select read_id, umi, canonical from u join c using (read_id)")
def sidecar_scan(s: S, d: str) -> DataFrame:
    """Reads and their UMIs, each pair once"""
    o = table(s, d, "observations").filter("length(sequence) >= 10").select(F.col("sequence_id").alias("read_id"), H.umi(F.expr("left(sequence, 10)")).alias("umi"))
    return airr.read_sidecar(s, written(evidence.umi_sidecar(o), sep="\t"))


@query("select r_name as region, n_name as nation, cast(n_nationkey as varchar) as key from nation join region on n_regionkey = r_regionkey")
def workbook_scan(s: S, d: str) -> DataFrame:
    """A sheet whose region cells are merged over their nations"""
    n = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name", F.col("n_nationkey").cast("string")).orderBy("r_name", "n_name").collect()
    rows, merged, first = [["region", "nation", "key"]], [], 1
    for i, (region, *rest) in enumerate(map(tuple, n), 1):
        same = i > 1 and n[i - 2][0] == region
        first = first if same else i
        rows.append([None if same else region, *rest])
        if same and (i == len(n) or n[i][0] != region):
            merged.append(f"A{first + 1}:A{i + 1}")
    path = new_path(s, ".xlsx")
    sinks.write_workbook(s, path, "Nations", rows, merged)
    return discovery.sheet_table(s, path, "Nations").select("region", "nation", "key")


_BARCODE = "translate(left(md5(n_name), 8), '0123456789abcdef', 'ACGTACGTACGTACGT')"


@query(f"select 'BC_00' || n_nationkey as name, {_BARCODE} as seq from nation")
def barcode_scan(s: S, d: str) -> DataFrame:
    """A barcode reference, checked"""
    return airr.read_barcodes(s, written(table(s, d, "nation").selectExpr("concat('BC_00', n_nationkey) as name", f"lower({_BARCODE}) as seq")))


@query(f"""select 'S' || n_nationkey as sample_id, cast(n_nationkey as varchar) as barcode, {_BARCODE} as barcode_sequence, case when n_nationkey % 2 = 0 then 'IGHA,IGHD,IGHE,IGHG,IGHM' else 'TRA,TRB' end as chains,
  case when n_nationkey % 2 = 0 then 'IGH' else 'TRA,TRB' end as database, n_name as dual_index, 'run/' || r_name as note from nation join region on n_regionkey = r_regionkey""")
def submission_scan(s: S, d: str) -> DataFrame:
    """Records of a submission sheet with notes that hold until the next"""
    n = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).selectExpr("r_name", "n_name", "n_nationkey as k").orderBy("r_name", "n_name").collect()
    rows, before = [["Submission of the month"], ["note", "SAMPLE  ID", "Barcode", "Dual Index", "Chain"]], None
    for r in n:
        rows.append(["run/" + r["r_name"] if r["r_name"] != before else "", f"S{r['k']}", f"bc{r['k']:03d}", r["n_name"], "TRA+trb" if r["k"] % 2 else "igh*"])
        before = r["r_name"]
    rows.append(rows[-1])  # delivered twice
    path = new_path(s, ".xlsx")
    sinks.write_workbook(s, path, "Sheet", rows)
    return inputs.submission_records(s, path, barcode_scan(s, d))


_PAIRS = "p as (select pair, count(*) as n, coalesce(bool_or(match_class = 'unique'), false) as whole, min(chain) as c from observations where pair is not null group by 1)"


def _read_files(s: S, d: str) -> DataFrame:
    """A listing: two ends for each pair with a unique match, one for the others, empty where the first chain is TRG."""
    p = table(s, d, "observations").filter("pair is not null").groupBy("pair").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.col("match_class") == "unique"), F.lit(False)).alias("whole"), F.min("chain").alias("c"))
    ends = F.explode(F.when(F.col("whole"), F.array(F.lit("_R1"), F.lit("_R2"))).otherwise(F.array(F.lit("_R1"))))
    return p.select("n", "c", "pair", ends.alias("e")).select(F.concat(F.lit("/in/run1/"), "pair", "e", F.lit(".fastq.gz")).alias("path"), F.concat(F.lit("run1/"), "pair", "e", F.lit(".fastq.gz")).alias("relative"), F.when(F.col("c") == "TRG", 0).otherwise(F.col("n")).cast("bigint").alias("size"))


@query(f"""with {_PAIRS} select 'run1/' || pair as pair_id, pair as sample_id, '/in/run1/' || pair || '_R1.fastq.gz' as r1, case when whole then '/in/run1/' || pair || '_R2.fastq.gz' else '' end as r2,
  whole and coalesce(c <> 'TRG', true) as valid, case when not whole then 'an end is missing or doubled' || (case when c = 'TRG' then '; empty file' else '' end) when c = 'TRG' then 'empty file' else '' end as error from p""")
def read_pair_scan(s: S, d: str) -> DataFrame:
    """Pairs of a listing"""
    return discovery.read_pairs(_read_files(s, d))


@query("select r_name as folder, count(*) as nations from nation join region on n_regionkey = r_regionkey group by 1")
def folder_listing(s: S, d: str) -> DataFrame:
    """The files of a folder, by what they hold"""
    n = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")
    path = written(n, compression="none", partition_by=["r_name"])
    files = discovery.list_files(s, path, r"\.csv$").select("path", F.regexp_extract("relative", "^r_name=([^/]*)/", 1).alias("folder"))
    rows = s.read.option("header", True).csv(path).select(F.col("_metadata.file_path").alias("f"))
    name = lambda c: F.regexp_extract(c, r"([^/]*/[^/]*)$", 1)
    return rows.join(files, name(F.url_decode("f")) == name("path")).groupBy("folder").agg(F.count(F.lit(1)).alias("nations"))


_RUNS = "r as (select distinct output_root as root, id, status from derived_runs where output_root is not null and id is not null)"


def _result_files(s: S, d: str) -> DataFrame:
    """A listing: a table and a chain's table for each run, and a summary where it succeeded."""
    r = table(s, d, "derived_runs").filter("output_root is not null and id is not null").select("output_root", "id", "status").distinct()
    names = F.when(F.col("status") == "succeeded", F.array(F.lit("a.csv"), F.lit("S_IGK.tsv"), F.lit("chain_summary.csv"))).otherwise(F.array(F.lit("a.csv"), F.lit("S_IGK.tsv")))
    rel = F.concat(F.substring("output_root", 2, 10_000), F.lit("/"), "id", F.lit("/"), "name")
    return r.select("output_root", "id", F.explode(names).alias("name")).select(F.concat(F.lit("/"), rel).alias("path"), rel.alias("relative"), F.lit(7).cast("bigint").alias("size")).distinct()


@query(f"""with {_RUNS}, k as (select distinct substr(root, 2) || '/' || id || '/' as folder, max(case when status = 'succeeded' then 1 else 0 end) over (partition by root, id) as any_ from r)
  select folder, folder || 'chain_summary.csv' as relative, 'summary' as kind, cast(null as varchar) as chain from k where any_ = 1
  union all select folder, folder || x, 'table', case when x = 'S_IGK.tsv' then 'IGK' end from k, (select unnest(['a.csv', 'S_IGK.tsv']) as x) where any_ = 0""")
def result_scan(s: S, d: str) -> DataFrame:
    """A folder's summary, or its tables"""
    return discovery.discover_results(_result_files(s, d)).drop("path")


@query("""with o as (select distinct sample_key, chain, matching_source as path, match_class from observations where sample_key is not null and matching_source is not null),
  v as (select sample_key, case when match_class = 'multiple' then null else chain end as chain, path from o where match_class is not null), k as (select distinct sample_key, path from v where chain is not null)
  select sample_key, chain, array_to_string(list_sort(list_distinct(list(path))), ';') as sources from (select * from v where chain is not null union all select * from v where chain is null and not exists (select 1 from k where k.sample_key = v.sample_key and k.path = v.path)) group by 1, 2""")
def consolidated_scan(s: S, d: str) -> DataFrame:
    """Entries of one sample and chain as one; a path known with a chain is not listed without"""
    o = table(s, d, "observations").filter("sample_key is not null and matching_source is not null").select("sample_key", "chain", F.col("matching_source").alias("path"), "match_class").distinct()
    e = o.select("sample_key", F.when(F.coalesce(F.col("match_class") != "multiple", F.lit(True)), F.col("chain")).alias("chain"), "path", F.col("match_class").isNotNull().alias("valid"))
    return discovery.consolidate(e).select("sample_key", "chain", F.array_join("sources", ";").alias("sources"))


# --- inputs by kind of pipeline (S16) -----------------------------------------------------------

_TASKS = "t as (select sample_key, min(sample) as sample_id, min(pair) as pair_id, chain, count(*) as n, max(case when match_class = 'multiple' then 1 else 0 end) as m from observations where sample_key is not null and chain is not null group by sample_key, chain)"


def _tasks(s: S, d: str) -> DataFrame:
    """A summary row per sample and chain: ERROR with 9 rows or more; and what its file is called."""
    t = table(s, d, "observations").filter("sample_key is not null and chain is not null").groupBy("sample_key", "chain").agg(F.min("sample").alias("sample_id"), F.min("pair").alias("pair_id"), F.count(F.lit(1)).alias("n"), F.max((F.col("match_class") == "multiple").cast("int")).alias("m"))
    return t.withColumn("m", F.coalesce("m", F.lit(0))).withColumn("status", F.when(F.col("n") >= 9, "error").otherwise("Ok"))


def _listing(df: DataFrame, relative, size) -> DataFrame:
    return df.select(F.concat(F.lit("/root/"), relative).alias("path"), relative.alias("relative"), size.cast("bigint").alias("size"))


def _kind_sql(kind: str, key: str, chain_column: str, path: str, first: str = "") -> str:
    return f"""select '{kind}' as kind, {key} as sample_key, sample_id as sample, chain, case when e = '' then {path} end as path, {chain_column} as chain_column, e = '' as valid, e as error from (select *, case {first}
      when n >= 9 then '{ {'mapping': 'count status ERROR', 'locus': 'split did not succeed'}.get(kind, 'mapping status ERROR')}' when m = 1 then 'file missing' when n = 1 then 'file empty' else '' end as e from t)"""


@query(f"with {_TASKS} " + _kind_sql("mapping", "sample_key", "''", "'/root/s3/' || sample_key || '/' || chain || '.tsv'") + " union all " + _kind_sql("locus", "sample_key", "'locus'", "'/root/s6/' || sample_key || '/' || chain || '.tsv'")
       + " union all " + _kind_sql("tasks", "coalesce(pair_id || '/', '') || sample_id", "case when n = 2 then '' else 'locus' end", "'/root/s5/' || sample_key || '/' || chain || '.tsv'", "when n = 2 then 'locus not filtered yet'"))
def summary_inputs(s: S, d: str) -> DataFrame:
    """Tables named by the summaries of re-mapping, locus split and base pipelines"""
    t = _tasks(s, d)
    there = t.filter("m = 0 and n < 9")
    at = lambda stage: F.concat(F.lit(stage + "/"), "sample_key", F.lit("/"), "chain", F.lit(".tsv"))
    size = F.when(F.col("n") == 1, 0).otherwise(F.col("n"))
    a = inputs.mapping_inputs(t.withColumn("source_file", F.concat("sample_key", F.lit("/"), "chain", F.lit(".csv"))), _listing(there, at("s3"), size), "s3", "/root")
    b = inputs.locus_inputs(t.withColumn("output_path", F.concat(F.lit("/root/"), at("s6"))).withColumn("error", F.lit(None).cast("string")), _listing(there, at("s6"), size), "/root")
    c = inputs.task_inputs(t.withColumn("output_path", F.concat(F.lit("/root/"), at("s5"))).withColumn("locus_filter_version", F.when(F.col("n") != 2, "1")), _listing(there, at("s5"), size), "/root", True)
    kinds = [x.select(F.lit(k).alias("kind"), "*") for k, x in (("mapping", a), ("locus", b), ("tasks", c))]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


@query("""with o as (select distinct sample_key, sample, chain from observations where sample_key is not null and sample is not null and chain is not null), k as (select sample_key, min(sample) as sample from o group by 1)
  select 'in/' || sample_key as sample_key, k.sample, o.chain, '/root/s8/junction_peps/in/' || sample_key || '/' || (case when starts_with(o.chain, 'TR') then 'TCR' else 'BCR' end) || '/' || o.chain || '.csv' as path, '' as chain_column, true as valid, '' as error from o join k using (sample_key)""")
def receptor_inputs_scan(s: S, d: str) -> DataFrame:
    """The receptor folders of bulk runs"""
    o = table(s, d, "observations").filter("sample_key is not null and sample is not null and chain is not null").select("sample_key", "sample", "chain").distinct()
    r = sinks.receptor("chain")
    m = o.groupBy("sample_key").agg(F.min("sample").alias("sample_id"), F.array_join(F.collect_set(F.lower(r)), ", ").alias("available_receptors")).select(F.lit("in").alias("label"), F.col("sample_key").alias("relative_sample"), "sample_id", F.lit("OK").alias("status"), "available_receptors")
    f = _listing(o, F.concat(F.lit("s8/junction_peps/in/"), "sample_key", F.lit("/"), r, F.lit("/"), "chain", F.lit(".csv")), F.lit(5))
    return inputs.receptor_inputs(m, f, "s8", "/root")


@query("""with o as (select sample_key, chain, coalesce(bool_or(match_class = 'unique'), false) as kept from observations where sample_key is not null and chain is not null group by 1, 2), k as (select sample_key, count(*) filter (where kept) as k, count(*) as n from o group by 1)
  select sample_key, regexp_extract(sample_key, '([^/]*)$', 1) as sample, case when k > 0 then chain end as chain, case when k > 0 then '/root/' || sample_key || '/t.tsv' end as path, 'locus' as chain_column, k > 0 as valid, case when k = 0 then 'no retained locus' else '' end as error
  from k left join o using (sample_key) where k.k = 0 or kept group by all""")
def droplet_inputs_scan(s: S, d: str) -> DataFrame:
    """Droplet tables with the retained loci of the summary beside them"""
    o = table(s, d, "observations").filter("sample_key is not null and chain is not null").groupBy("sample_key", "chain").agg(F.coalesce(F.max(F.col("match_class") == "unique"), F.lit(False)).alias("kept"))
    loci = o.select(F.concat("sample_key", F.lit("/t.stage8_summary.csv")).alias("summary"), F.lower("chain").alias("locus"), F.col("kept").cast("string").alias("retained"))
    names = F.explode(F.array(F.lit("/t.tsv"), F.lit("/t.stage8_summary.csv")))
    return inputs.droplet_inputs(loci, _listing(o.select("sample_key").distinct().withColumn("x", names), F.concat("sample_key", "x"), F.lit(5)))


@query("""with o as (select distinct sample_key, chain from observations where sample_key is not null) select sample_key, regexp_extract(sample_key, '([^/]*)$', 1) as sample, chain, '/root/' || sample_key || coalesce('.' || chain, '') || '.tsv.gz' as path, '' as chain_column, true as valid, '' as error from o""")
def folder_inputs_scan(s: S, d: str) -> DataFrame:
    """Every table of any folder, by its name"""
    o = table(s, d, "observations").filter("sample_key is not null").select("sample_key", "chain").distinct()
    return inputs.folder_inputs(_listing(o, F.concat("sample_key", F.coalesce(F.concat(F.lit("."), "chain"), F.lit("")), F.lit(".tsv.gz")), F.lit(5)))


# --- further scans ------------------------------------------------------------------------------


@query(composition.ORACLE["lineage_links"])
def trace_scan(s: S, d: str) -> DataFrame:
    """Observations joined to a written annotation trace"""
    a = composition._annotations(s, d).select("ordinal", "sample_key", "chain", "sequence_id", "v_call").filter("sequence_id is not null and sample_key is not null")
    back = airr.read_table(s, written(a, sep="\t")).withColumn("ordinal", F.col("ordinal").cast("bigint"))
    o = roles.observations(s, d, "sample_key", "chain", "mapping_sequence_id")
    return lineage.unique_join(o, back, ["sample_key", "chain", "mapping_sequence_id"], ["sample_key", "chain", "sequence_id"], "ordinal", ["v_call"]).select("id", "n_matches", "v_call")


@query("""with g as (select distinct segment, gene from composition_calls where gene <> '' and segment in ('V', 'J')) select segment, gene || '*01' as allele, gene, sha256(upper(translate(md5(gene), '0123456789abcdef', 'acgtacgtacgtacgt'))) as sequence_sha256 from g""")
def reference_gene_scan(s: S, d: str) -> DataFrame:
    """Alleles with their sequences' hash; sequences of one base (here those of C) are none"""
    g = table(s, d, "composition_calls").filter("gene <> ''").select("segment", "gene").distinct()
    seq = F.when(F.col("segment") == "C", "a").otherwise(F.translate(F.md5("gene"), "0123456789abcdef", "acgtacgtacgtacgt"))
    alleles = g.select("segment", F.concat("gene", F.lit("*01")).alias("allele"), seq.alias("sequence"))
    return discovery.reference_genes(airr.read_table(s, written(alleles)))


@query(f"with {AIRR_SQL} select sample, locus as chain, cdr3_aa, umi_counts as copy from airr where cdr3_aa is not null")
def mapping_input_scan(s: S, d: str) -> DataFrame:
    """A file for each sample and chain, named by them"""
    a = roles.airr(s, d).filter("cdr3_aa is not null").select("cdr3_aa", F.col("umi_counts").alias("copy"), F.concat("sample", F.lit("__"), F.lower("locus"), F.lit(".csv")).alias("file"))
    folder = new_path(s)
    sinks.write_named(a, folder, "file")
    return airr.read_mapping_inputs(s, f"{folder}/*.csv").select("sample", "chain", "cdr3_aa", F.col("copy").cast("bigint").alias("copy"))


@query(f"select sample, 'b1' as batch, metric, value from (unpivot ({repertoire.ORACLE['datapoint_wide']}) on \"IGH_D50\", \"IGH_Shannon_index\", \"TRB_D50\" into name metric value value) where sample in ('O', 'F')")
def metrics_scan(s: S, d: str) -> DataFrame:
    """The selected samples of a written metrics table"""
    wide = repertoire.datapoint_wide(s, d).withColumn("batch", F.lit("b1"))
    return rounded(discovery.published_metrics(airr.read_table(s, written(wide)), ["O", "F"]).filter("value is not null"))


@query("with j as (select distinct id, pipeline, status, last_error from jobs where id is not null and upper(status) = 'ERROR' or (id is not null and contains(lower(concat_ws(' ', coalesce(id, ''), coalesce(pipeline, ''), coalesce(status, ''), coalesce(last_error, ''))), 'fail'))) select id, pipeline, status from j order by id limit 5 offset 5")
def summary_preview(s: S, d: str) -> DataFrame:
    """The second page of a summary that is searched"""
    j = table(s, d, "jobs").filter("id is not null").select("id", "pipeline", "status", "last_error").distinct()
    files = s.createDataFrame([(f"{d}/jobs.parquet", 1, 1)], "path string, size bigint, modified bigint")
    version = evidence.version_of(files, "fail")
    _, cursor = evidence.preview(j, "id", version, size=5, query="fail")
    rows = evidence.preview(j, "id", version, cursor, size=5, query="fail")[0] if cursor else []
    return s.createDataFrame([(r["id"], r["pipeline"], r["status"]) for r in rows], "id string, pipeline string, status string")


# --- sinks --------------------------------------------------------------------------------------


@query("select c_custkey, c_name from customer")
def published_table(s: S, d: str) -> DataFrame:
    """A table published over another one"""
    path = new_path(s)
    sinks.write_csv(table(s, d, "nation").select("n_nationkey", "n_name"), path)
    sinks.write_csv(table(s, d, "customer").select("c_custkey", "c_name"), path)
    return airr.read_table(s, path).withColumn("c_custkey", F.col("c_custkey").cast("bigint"))


@query(f"with {AIRR_SQL} select sample, case when starts_with(locus, 'TR') then 'TCR' else 'BCR' end as receptor, locus, v_call, cdr3_aa, umi_counts from airr")
def junction_files(s: S, d: str) -> DataFrame:
    """Tables by sample, receptor and locus with a fixed list of columns"""
    a = roles.airr(s, d).withColumn("receptor", sinks.receptor("locus"))
    path = written(a, columns=["v_call", "cdr3_aa", "umi_counts", "sample", "receptor", "locus"], partition_by=["sample", "receptor", "locus"])
    return s.read.option("header", True).schema("v_call string, cdr3_aa string, umi_counts bigint, sample string, receptor string, locus string").csv(path)


@query(f"with a as (select distinct ordinal, sample_key, chain, locus, v_call, productive, sequence_id from annotations) select sequence_id, locus, v_call, productive from a where {repertoire._V_OK} and {repertoire._P_OK} and coalesce(upper(trim(locus)) = upper(trim(chain)), false) and {repertoire._L_OK}")
def filtered_file(s: S, d: str) -> DataFrame:
    """The rows that a filter keeps, in their source's columns and order"""
    a = table(s, d, "annotations").select("ordinal", "sample_key", "chain", "locus", "v_call", "productive", "sequence_id").distinct()
    kept = a.withColumn("reason", filters.mapping_reason("chain")).filter("reason = 'retained'").drop("reason")
    return airr.read_table(s, lined(kept.select("sequence_id", "locus", "v_call", "productive"), "# filtered"))


@query("""with o as (select split_part(sample_key, '/', 1) as input_root, split_part(sample_key, '/', 2) as relative_sample, sample, pair, chain, filter_reason, match_class from observations where sample_key is not null and sample is not null and chain is not null),
  r as (select input_root, relative_sample, min(sample) as sample, (case when starts_with(chain, 'TR') then 'TCR' else 'BCR' end) as receptor, count(*) filter (where filter_reason = 'retained') as n_rows, count(*) filter (where match_class = 'unique') as m, count(*) as t from o group by 1, 2, 4),
  g as (select input_root, relative_sample, min(sample) as sample, array_to_string(list_sort(list(receptor)), ',') as available_receptors, coalesce(max(case when receptor = 'TCR' then relative_sample || '/TCR' end), '') as tcr_path, coalesce(max(case when receptor = 'BCR' then relative_sample || '/BCR' end), '') as bcr_path,
    cast(sum(n_rows) as bigint) as n_rows, cast(sum(m) as bigint) as state_matched_rows, cast(sum(t - m) as bigint) as state_unmatched_rows, max(case when t = 1 then 1 else 0 end) as bad from r group by 1, 2)
  select input_root, relative_sample, sample, available_receptors, tcr_path, bcr_path, n_rows, state_matched_rows, state_unmatched_rows, case when bad = 1 then 'ERROR' when n_rows = 0 then 'EMPTY' else 'OK' end as status, case when bad = 1 then 'one row only' else '' end as error, case when bad = 1 then '0' else '1' end as row_contract_valid from g""")
def processing_manifest(s: S, d: str) -> DataFrame:
    """What became of each sample"""
    o = table(s, d, "observations").filter("sample_key is not null and sample is not null and chain is not null")
    at = F.split("sample_key", "/")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    r = o.groupBy(at[0].alias("input_root"), at[1].alias("relative_sample"), sinks.receptor("chain").alias("receptor")).agg(F.min("sample").alias("sample"), n(F.col("filter_reason") == "retained").alias("n_rows"), n(F.col("match_class") == "unique").alias("state_matched_rows"), F.count(F.lit(1)).alias("state_total_rows"))
    own = F.min("sample").over(Window.partitionBy("input_root", "relative_sample"))
    r = r.withColumns({
        "sample": own, "batch": F.lit("-"), "path": F.concat_ws("/", "relative_sample", "receptor"), "state_unmatched_rows": F.col("state_total_rows") - F.col("state_matched_rows"), "umi_source": F.lit("row_contract"),
        "error": F.when(F.col("state_total_rows") == 1, "one row only").otherwise(""),
    })
    return stages.processing_manifest(r).drop("batch", "umi_source", "state_total_rows")


_VIEWS = {
    "sample_gene_usage": "primer = '' and (unique_count > 0 or ambiguous_count > 0)", "primer_gene_usage": "primer <> '' and (unique_count > 0 or ambiguous_count > 0)",
    "reference_gene_observation": "primer = '' and reference_catalog = 1", "primer_reference_gene_observation": "primer <> '' and reference_catalog = 1",
    "unobserved_reference_genes": "primer = '' and reference_catalog = 1 and status = 'zero_observed'", "primer_unobserved_reference_genes": "primer <> '' and reference_catalog = 1 and status = 'zero_observed'",
}


@query(composition._USAGE + " " + " union all ".join(f"select '{n}' as view_name, group_id, primer, segment, gene, unique_count, ambiguous_count, status from usage where {w}" for n, w in _VIEWS.items()))
def usage_exports(s: S, d: str) -> DataFrame:
    """The six views of gene usage as written files"""
    views = evidence.exports(composition._usage(s, d)[2])
    cols = ["group_id", "primer", "segment", "gene", "unique_count", "ambiguous_count", "status"]
    out = None
    for n, v in views.items():
        back = airr.read_table(s, written(v.select(*cols)), cols).select(F.lit(n).alias("view_name"), *(F.col(c).cast("bigint").alias(c) if c.endswith("_count") else F.coalesce(F.col(c), F.lit("")).alias(c) if c == "primer" else F.col(c) for c in cols))
        out = back if out is None else out.unionByName(back)
    return out


@query("""select 'customer' as table_name, 5 as columns, count(*) as rows from customer union all select 'nation', 3, count(*) from nation union all select 'job_status:' || coalesce(status, 'None'), 0, count(*) from (select distinct id, status from jobs) group by status""".replace(" 5 as", " cast((select count(*) from (describe customer)) as int) as").replace("'nation', 3", "'nation', cast((select count(*) from (describe nation)) as int)"))
def summary_manifest(s: S, d: str) -> DataFrame:
    """The manifest of a run, read as JSON"""
    facts = {"job_status": table(s, d, "jobs").select("id", "status").distinct().groupBy("status").count()}
    path = new_path(s, ".json")
    sinks.write_bytes(s, path, evidence.summary_json({n: table(s, d, n) for n in ("customer", "nation")}, facts=facts).encode())
    m = json.loads(s.read.text(path, wholetext=True).first()[0])
    rows = [(n, len(t["columns"]), t["rows"]) for n, t in m["tables"].items()] + [(f"job_status:{k}", 0, v) for k, v in m["facts"]["job_status"].items()]
    return s.createDataFrame(rows, "table_name string, columns int, rows bigint")


@query("with x as (" + composition._STAGE_SQL + """) select sample as "Sample", case stage when 'raw' then 'Raw read ends' when 'clean' then 'Clean read ends' else stage end as "Stage", count as "Reads" from x""")
def lab_table(s: S, d: str) -> DataFrame:
    """Columns and stages as a laboratory reads them"""
    rows, pairs = composition._stage_rows(s, d)
    v = stages.stage_volumes(stages.stage_totals(rows, pairs))
    return evidence.relabel(v, {"sample": "Sample", "stage": "Stage", "count": "Reads", "absent": "Absent"}, {"stage": {"raw": "Raw read ends", "clean": "Clean read ends"}})


@query("with " + composition._SUMMARY + """, p as (select *, case when denominator <> 0 then round(cast(100 as double) * count / denominator, 6) end as percent from su)
  select sample_key, max(denominator) as denominator, max(percent) filter (where match_class = 'unique') as unique_percent, max(percent) filter (where match_class = 'multiple') as multiple_percent, max(percent) filter (where match_class = 'unmatched') as unmatched_percent, max(unassessed_count) as unassessed_count from p group by 1""")
def lab_matching(s: S, d: str) -> DataFrame:
    """Match percentages side by side"""
    return rounded(evidence.wide_matching(composition._summary(composition._categorised(s, d)), ["sample_key"]))


# --- values and lookups -------------------------------------------------------------------------


@query("""with o as (select distinct id, upper(left(sequence, 10)) as u, sequence_id, match_class from observations where length(sequence) >= 10 and sequence_id is not null)
  select id, u as umi, case when match_class = 'multiple' then null else u end as header_umi from o""")
def umi_forms(s: S, d: str) -> DataFrame:
    """UMIs written as #UMI:x, #x and in headers"""
    o = table(s, d, "observations").filter("length(sequence) >= 10 and sequence_id is not null").select("id", F.expr("lower(left(sequence, 10))").alias("u"), "sequence_id", "match_class").distinct()
    written_ = F.when(F.col("match_class") == "unique", F.concat(F.lit("#UMI:"), "u")).when(F.col("match_class") == "unmatched", F.concat(F.lit(" #"), "u")).otherwise(F.col("u"))
    head = F.when(F.col("match_class") == "multiple", F.col("sequence_id")).when(F.col("match_class") == "unique", F.concat("sequence_id", F.lit("#UMI:"), "u", F.lit(" tail"))).otherwise(F.concat("sequence_id", F.lit("#"), "u"))
    return o.select("id", H.umi(written_).alias("umi"), H.header_umi(head).alias("header_umi"))


@query(f"with {AIRR_SQL} select ordinal, umi_counts as copies from airr")
def copy_counts(s: S, d: str) -> DataFrame:
    """copies from one or both of their columns, as texts"""
    a = roles.airr(s, d).select("ordinal", F.when(F.col("locus") != "TRG", F.col("umi_counts").cast("string")).alias("copy"), F.when(F.col("locus") != "IGH", F.concat("umi_counts", F.lit(".0"))).otherwise("").alias("umi_counts"))
    return a.select("ordinal", V.copy_count().alias("copies"))


@query("select n_nationkey, cast(n_nationkey as varchar) as name, cast(null as varchar) as other from nation")
def barcode_names(s: S, d: str) -> DataFrame:
    """BC_007, bc7 and 7 are one barcode; other names are none"""
    n = table(s, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") > 12, F.format_string("BC_%03d", "n_nationkey")).when(F.col("n_nationkey") > 5, F.concat(F.lit(" bc"), "n_nationkey")).otherwise(F.col("n_nationkey").cast("string")).alias("x"), "n_name")
    return n.select("n_nationkey", H.barcode_name("x").alias("name"), H.barcode_name("n_name").alias("other"))


_OLIGO = "translate(left(md5(p_name), 12), '0123456789abcdef', 'ACGTRYSWACGTKMBN')"


@query(f"""with p as (select distinct p_brand, p_name from part), k as (select distinct 'S' || c_nationkey as sample, case c_mktsegment when 'BUILDING' then null else 'IGH' end as chain, 'Brand#' || (1 + c_nationkey % 25) as grp from customer)
  select sample, chain, grp, p_name as name, {_OLIGO} as sequence from k join p on p_brand = grp""")
def primer_catalogue(s: S, d: str) -> DataFrame:
    """The catalogue of a primer sheet for the samples' groups"""
    code = f"concat('{primers.ADAPTER}', repeat('N', {primers.UMI_LENGTH}), 'ACGTACGT', {_OLIGO})"
    sheet = [tuple(r) for r in table(s, d, "part").selectExpr("p_brand", "p_name", f"{code} as oligo").distinct().collect()]  # a primer sheet is a sheet
    c = table(s, d, "customer").select("c_nationkey", "c_mktsegment").distinct().collect()
    chosen = sorted({(f"Sample {r['c_nationkey']}", None if r["c_mktsegment"] == "BUILDING" else "IGH", f"Brand#{1 + r['c_nationkey'] % 25}") for r in c}, key=str)
    have = {g for g, _, _ in sheet}
    chosen = [x for x in chosen if x[2] in have]
    aliases = {"S" + x[0].split()[1]: x[0] for x in chosen}
    return primers.build_catalogue(s, sheet, chosen, sorted(aliases), aliases)


@query("""with o as (select distinct sample, chain from observations where sample is not null and chain is not null), p as (select distinct sample, chain, match_class as name from observations where match_class in ('unique', 'multiple') and sample is not null and chain is not null)
  select o.sample, o.chain, array_to_string(list_sort(list_distinct(list_concat(coalesce((select list(name) from p where p.sample = o.sample and p.chain = o.chain), []), ['any_' || o.chain]))), ',') as names from o""")
def primer_assignment(s: S, d: str) -> DataFrame:
    """The primers of a sample and chain, given for both or for the chain"""
    o = table(s, d, "observations").filter("sample is not null and chain is not null")
    p = o.filter("match_class in ('unique', 'multiple')").select("sample", "chain", F.col("match_class").alias("name")).distinct()
    p = p.unionByName(o.select(F.lit(None).cast("string").alias("sample"), "chain", F.concat(F.lit("any_"), "chain").alias("name")).distinct())
    return discovery.assigned_primers(o.select("sample", "chain").distinct(), p).select("sample", "chain", F.array_join("names", ",").alias("names"))


@query("""with o as (select distinct id, sample_key, chain from observations), c as (select distinct sample_key, chain from annotations where deleted_at is null) select o.* from o where exists (select 1 from c where c.sample_key = o.sample_key and c.chain = o.chain)""")
def scoped_observations(s: S, d: str) -> DataFrame:
    """The observations of the annotated scopes"""
    scope = table(s, d, "annotations").filter("deleted_at is null").select("sample_key", "chain")
    return evidence.scoped(table(s, d, "observations").select("id", "sample_key", "chain").distinct(), scope, ["sample_key", "chain"])


@query("""with m as (select distinct sequence_id, upper(left(sequence, 8)) as barcode from observations where sequence_id is not null and length(sequence) >= 8), k as (select sequence_id, min(barcode) as barcode, count(*) as n from m group by 1), a as (select sequence_id, locus from annotations where sequence_id is not null)
  select 'kept' as part, sequence_id, locus, barcode from a join (select * from k where n = 1) using (sequence_id) union all select distinct 'lost', sequence_id, cast(null as varchar), cast(null as varchar) from a where not exists (select 1 from k where n = 1 and k.sequence_id = a.sequence_id)""")
def barcode_map(s: S, d: str) -> DataFrame:
    """Rows with their barcode, and the ids without exactly one"""
    m = table(s, d, "observations").filter("sequence_id is not null and length(sequence) >= 8").select("sequence_id", F.upper(F.expr("left(sequence, 8)")).alias("barcode")).distinct()
    rows, lost = evidence.attach_barcodes(table(s, d, "annotations").filter("sequence_id is not null").select("sequence_id", "locus"), m)
    return rows.select(F.lit("kept").alias("part"), "sequence_id", "locus", "barcode").unionByName(lost.select(F.lit("lost").alias("part"), "sequence_id", F.lit(None).cast("string").alias("locus"), F.lit(None).cast("string").alias("barcode")))


@query(f"""with {RECORDS_SQL}, a as (select record_id, segment, array_to_string(list_sort(list_distinct(list(gene))), ',') as candidates from calls where assignment = 'ambiguous' and gene <> '' group by 1, 2)
  select group_id, segment, candidates, count(*) as records from a join (select distinct id, group_id from records) r on record_id = id group by 1, 2, 3""")
def candidate_gene_summary(s: S, d: str) -> DataFrame:
    """Records per set of candidate genes"""
    r = roles.records(s, d).select("id", "group_id").distinct()
    return evidence.candidate_genes(evidence.candidate_sets(roles.calls(s, d)).join(r, F.col("record_id") == F.col("id")))


@query("""with g as (select distinct gene, segment from composition_calls where gene is not null), f as (""" + repertoire.ORACLE["gene_family"] + """), n as (""" + repertoire.ORACLE["natural_gene_order"] + """)
  select gene, segment, family, coalesce(order_key, '') as order_key, exists(select 1 from observations where list_contains(""" + C.sql_calls("v_call") + """, gene)) as observed from g join f using (gene, segment) left join n using (gene)""")
def sql_functions(s: S, d: str) -> DataFrame:
    """Names of genes in SQL"""
    C.register_functions(s)
    table(s, d, "composition_calls").createOrReplaceTempView("_sql_calls")
    table(s, d, "observations").select("v_call").distinct().createOrReplaceTempView("_sql_observed")
    return s.sql("""with g as (select distinct gene, segment from _sql_calls where gene is not null), o as (select distinct x as og from (select explode(split(v_call, '[,;]')) as c, v_call from _sql_observed) lateral view explode(array(trim(both ' \t' from split(c, '[*]')[0]))) t as x where gene_has(v_call, x))
      select gene, segment, gene_family(gene, segment) as family, gene_order(gene) as order_key, og is not null as observed from g left join o on gene = og""")


# what each character of a text becomes in the compatibility form; a rule of the standard library, not of the operator
_COMPATIBLE = ", ".join(f"({c}, {sql_text(unicodedata.normalize('NFKC', chr(c)))})" for c in range(0x80, 0x10000) if not 0xD800 <= c <= 0xF8FF and unicodedata.normalize("NFKC", chr(c)) != chr(c) and "\0" not in unicodedata.normalize("NFKC", chr(c)))


@query(f"""with m as (select * from (values {_COMPATIBLE}) t(code, form)), x as (select doc_id, text, generate_subscripts(string_split(text, ''), 1) as i, unnest(string_split(text, '')) as c from documents where text is not null and text <> ''),
  y as (select doc_id, string_agg(coalesce(form, c), '' order by i) as t from x left join m on unicode(c) = code group by 1) select d.doc_id, case when d.text = '' then '' else nfc_normalize(t) end as text from documents d left join y using (doc_id)""")
def nfkc_text(s: S, d: str) -> DataFrame:
    """Texts in their compatibility form"""
    return table(s, d, "documents").select("doc_id", V.nfkc("text").alias("text"))


@query("""select l_orderkey, l_linenumber, round(ln(1 + l_quantity), 6) as log_quantity, round(sqrt(l_extendedprice), 6) as root_price, round(pow(10.0, -l_discount), 6) as power, cast(floor(l_extendedprice / 7) as bigint) as floor_price, greatest(l_quantity, l_linenumber * 10.0) as larger from lineitem""")
def math_functions(s: S, d: str) -> DataFrame:
    """Y04"""
    return rounded(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.log1p("l_quantity").alias("log_quantity"), F.sqrt("l_extendedprice").alias("root_price"), F.pow(F.lit(10.0), -F.col("l_discount")).alias("power"), F.floor(F.col("l_extendedprice") / 7).alias("floor_price"), F.greatest(F.col("l_quantity").cast("double"), F.col("l_linenumber") * 10.0).alias("larger")))


@query(f"""with o as (select distinct id, {C.sql_calls('v_call')} as v, {C.sql_calls('j_call')} as j from observations) select id, array_to_string(list_sort(list_distinct(list_concat(v, j))), ',') as genes, len(v) as n_v, list_contains(v, 'IGHV5-190') as has, coalesce(list_sort(v)[1], '') as first from o""")
def array_functions(s: S, d: str) -> DataFrame:
    """Y06"""
    o = roles.observations(s, d, "v_call", "j_call").select("id", C.calls("v_call").alias("v"), C.calls("j_call").alias("j"))
    return o.select("id", F.array_join(F.array_sort(F.array_union("v", "j")), ",").alias("genes"), F.size("v").cast("bigint").alias("n_v"), F.array_contains("v", "IGHV5-190").alias("has"), F.coalesce(F.get("v", F.lit(0)), F.lit("")).alias("first"))


# --- evidence, receipts, checkpoints ------------------------------------------------------------


@query("""with l as (select string_agg(c_name, chr(10) order by c_custkey) || chr(10) as t from customer), m as (select string_agg(c_name, chr(10) order by c_custkey) filter (where c_nationkey <> 3) || chr(10) as t from customer), r as (select string_agg(n_name, chr(10) order by n_nationkey) || chr(10) as t from nation)
  select 'customers' as file, length(t) as size, sha256(left(t, 65536)) as head_sha256, 'changed' as state from l union all select 'nations', length(t), sha256(left(t, 65536)), 'unchanged' from r""")
def source_receipts(s: S, d: str) -> DataFrame:
    """Sizes and hashes of files, and which of them another look finds changed"""
    folder = new_path(s)
    names = {"customers": table(s, d, "customer").orderBy("c_custkey").select("c_name"), "nations": table(s, d, "nation").orderBy("n_nationkey").select("n_name")}
    put = lambda n, df: sinks.write_bytes(s, f"{folder}/{n}", "".join(f"{r[0]}\n" for r in df.collect()).encode())
    for n, df in names.items():
        put(n, df)
    file = F.regexp_extract("path", "([^/]*)$", 1).alias("file")
    before = s.createDataFrame(airr.receipts(s, f"{folder}/*").collect(), "path string, size bigint, modified timestamp, head_sha256 string")
    put("customers", table(s, d, "customer").filter("c_nationkey <> 3").orderBy("c_custkey").select("c_name"))
    seen = airr.changed(before, airr.receipts(s, f"{folder}/*")).select(F.col("path").alias("_p"), "state")
    return before.join(seen, F.col("path") == F.col("_p"), "left").select(file, "size", "head_sha256", F.coalesce("state", F.lit("unchanged")).alias("state"))


@query("""with j as (select distinct id, status from jobs where id is not null), r as (select distinct lower(trim(parent_job_id, ' ' || chr(9) || chr(10))) as job, output_root, total from derived_runs where parent_job_id is not null and output_root is not null), b as (select job, bool_and(total >= 7) as ok from (select job, output_root, total from r) group by 1)
  select j.id as run_id, status = 'SUCCEEDED' and coalesce(ok, false) as published from j left join b on b.job = j.id where status is not null""")
def published_runs(s: S, d: str) -> DataFrame:
    """Runs that are done and whose files are there unchanged"""
    runs = table(s, d, "jobs").filter("id is not null and status is not null").select(F.col("id").alias("run_id"), F.when(F.col("status") == "SUCCEEDED", "DONE").otherwise(F.col("status")).alias("state")).distinct()
    r = table(s, d, "derived_runs").filter("parent_job_id is not null and output_root is not null").select(F.expr("lower(trim(BOTH ' \t\n' FROM parent_job_id))").alias("run_id"), F.concat_ws("#", "output_root", F.coalesce(F.col("total").cast("string"), F.lit(""))).alias("path"), F.coalesce("total", F.lit(0)).alias("size")).distinct()
    now = r.filter("size >= 7").select("path", "size", F.md5("path").alias("sha256")).distinct()
    return evidence.published(runs, r.withColumn("sha256", F.md5("path")), now)


@query("""with o as (select distinct sample, chain, split_part(sample_key, '/', 1) as folder, sample_key from observations where sample is not null and chain is not null and sample_key is not null), g as (select sample, chain, count(distinct folder) as k, min(folder) as folder, count(*) as n from o group by 1, 2)
  select sample, chain, case when k > 1 then 'multiple_preprocessing_sources' when folder = 'ds01' then 'preprocessing_unavailable' when folder = 'ds02' then 'preprocessing_not_published' when folder = 'ds03' then 'preprocessing_sample_unverified' when folder = 'ds04' then 'preprocessing_scope_unverified' else 'complete' end as status from g""")
def composition_sources(s: S, d: str) -> DataFrame:
    """Whether a sample's rows come from one published folder, as its manifest says"""
    o = table(s, d, "observations").filter("sample is not null and chain is not null and sample_key is not null").select("sample", "chain", F.split("sample_key", "/")[0].alias("folder"), F.col("sample_key").alias("path")).distinct()
    m = o.withColumn("status", F.lit("OK")).withColumn("path", F.when(F.col("folder") == "ds04", F.concat("path", F.lit("x"))).otherwise(F.col("path")))
    m = m.select("folder", "sample", "chain", "status", "path").unionByName(m.filter("folder = 'ds03'").select("folder", "sample", "chain", "status", "path"))
    done = o.select("folder").distinct().filter("folder <> 'ds01'").withColumn("published", F.col("folder") != "ds02")
    return evidence.composition_source(o, m, done)


@query("select distinct output_root as path, true as inside, false as above, not starts_with(output_root, '/srv/') and false as elsewhere from derived_runs where output_root is not null")
def confined_paths(s: S, d: str) -> DataFrame:
    """Paths below a root, paths that lead out of it, and paths elsewhere"""
    p = table(s, d, "derived_runs").filter("output_root is not null").select(F.col("output_root").alias("path")).distinct()
    return p.select("path", inputs.confined("path", "/srv").alias("inside"), inputs.confined(F.concat("path", F.lit("/../../../etc")), "/srv").alias("above"), inputs.confined("path", "/other").alias("elsewhere"))


@query(f"with {RECORDS_SQL} select group_id, cast(sum(weight) as bigint) as total from records where weight is not null group by 1")
def asserted_totals(s: S, d: str) -> DataFrame:
    """Parts that must add up to their totals"""
    r = roles.records(s, d).filter("weight is not null")
    parts = r.groupBy("group_id", "sample_record", "primer").agg(F.sum("weight").alias("part"))
    return evidence.assert_totals(parts, r.groupBy("group_id").agg(F.sum("weight").alias("total")), ["group_id"], "part", "total")


@query("""with o as (select distinct pair, chain, sample, output from (select pair, chain, sample, matching_source as output from observations where pair is not null and sample is not null and chain is not null and matching_source is not null))
  select sample as sample_id, pair as pair_id, chain, array_to_string(list_sort(list(output)), ';') as sources, sample as label, sha256(sample || chr(0) || pair || chr(0) || chain) as task_id from o group by 1, 2, 3""")
def task_plans(s: S, d: str) -> DataFrame:
    """A task for each sample, pair and chain"""
    o = table(s, d, "observations").filter("pair is not null and sample is not null and chain is not null and matching_source is not null")
    t = o.select(F.col("sample").alias("sample_id"), F.col("pair").alias("pair_id"), F.lower("chain").alias("chain"), F.lit("ok").alias("status"), F.col("matching_source").alias("output_path")).distinct()
    return evidence.task_plan(t).select("sample_id", "pair_id", "chain", F.array_join("sources", ";").alias("sources"), "label", "task_id")


@query("""with j as (select distinct id, progress from jobs where id is not null) select id, progress, row_number() over (order by progress desc nulls last, id) as task_order from j""")
def task_order(s: S, d: str) -> DataFrame:
    """The largest tasks first"""
    return matching.largest_first(table(s, d, "jobs").filter("id is not null").select("id", "progress").distinct(), "progress", ["id"])


@query("select cast(count(*) as bigint) as rows, cast(ceil(count(*) / 1000.0) as bigint) as batches, cast(sum(c_custkey) as bigint) as keys from customer")
def row_batches(s: S, d: str) -> DataFrame:
    """Rows handed to a consumer in batches"""
    n = rows = keys = 0
    for b in evidence.batches(table(s, d, "customer").select("c_custkey"), 1000):
        n, rows, keys = n + 1, rows + len(b), keys + sum(r[0] for r in b)
    return s.createDataFrame([(rows, n, keys)], "rows bigint, batches bigint, keys bigint")


@query("""with e as (select distinct sample, chain from observations where sample is not null and chain is not null), f as (select distinct sample, chain from observations where sample is not null and chain is not null and filter_reason = 'retained') select distinct sample from e where not exists (select 1 from e x where x.sample = e.sample and not exists (select 1 from f where f.sample = x.sample and f.chain = x.chain))""")
def complete_samples(s: S, d: str) -> DataFrame:
    """Samples all of whose chains are done"""
    o = table(s, d, "observations").filter("sample is not null and chain is not null")
    return windows.complete_samples(o.filter("filter_reason = 'retained'").select("sample", "chain"), o.select("sample", "chain"))


@query("select event_type, count(*) as n from events group by 1")
def followed_folder(s: S, d: str) -> DataFrame:
    """A growing folder, read on from where the last call stopped"""
    e = table(s, d, "events").select("event_id", "event_type", "ts")
    folder, out, mark = (new_path(s) for _ in range(3))
    for part in ("ts < timestamp_ntz'2024-01-05'", "not ts < timestamp_ntz'2024-01-05'"):
        e.filter(part).drop("ts").write.mode("append").parquet(folder)
        windows.follow(s, folder, "event_id bigint, event_type string", out, mark, lambda x: x).awaitTermination()
    return s.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("select 'half' as step, cast(sum(case when n_nationkey < 10 then 1 else 0 end) as bigint) as rows, 'observed' as status from nation union all select 'whole', count(*), 'observed' from nation union all select 'shrunk', count(*), 'unavailable' from nation")
def observed_file(s: S, d: str) -> DataFrame:
    """A growing file with a line that is not finished, and one that became shorter"""
    n = [r[0] for r in table(s, d, "nation").orderBy("n_nationkey").select("n_name").collect()]
    path, state, out = new_path(s, ".tsv"), None, []
    lines = "sequence_id\tn\n" + "".join(f"{x}\t1\n" for x in n)
    cut = len("sequence_id\tn\n" + "".join(f"{x}\t1\n" for x in n[:10])) + 3
    for step, text in (("half", lines[:cut]), ("whole", lines), ("shrunk", lines[:5])):
        sinks.write_bytes(s, path, text.encode())
        state = windows.observe(s, path, state)
        out.append((step, state["rows"], state["status"]))
    return s.createDataFrame(out, "step string, rows bigint, status string")


@query("""with e as (select user_id as source, cast(row_number() over (partition by user_id order by event_id) as bigint) as ordinal, event_type from events), c as (select source, floor(count(*) / 2) as done from e where true group by 1 having count(*) filter (where event_type = 'click') > 0)
  select source, count(*) filter (where ordinal <= coalesce(done, 0)) as kept, count(*) filter (where ordinal > coalesce(done, 0)) as to_do from e left join c using (source) group by 1""")
def resumed_reads(s: S, d: str) -> DataFrame:
    """Records after the last committed one of their source"""
    e = table(s, d, "events").select(F.col("user_id").alias("source"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("bigint").alias("ordinal"), "event_type")
    c = e.groupBy("source").agg(F.floor(F.count(F.lit(1)) / 2).alias("records"), F.max(F.col("event_type") == "click").alias("any")).filter("any").drop("any")
    kept, todo = evidence.resume_at(e, c)
    both = kept.select("source", F.lit(1).alias("k"), F.lit(0).alias("t")).unionByName(todo.select("source", F.lit(0).alias("k"), F.lit(1).alias("t")))
    return both.groupBy("source").agg(F.sum("k").alias("kept"), F.sum("t").alias("to_do"))


@query("""with o as (select distinct sample, matching_source as path, match_class from observations where sample is not null and matching_source is not null), a as (select sample, array_to_string(list_sort(list(distinct path || '|1|1')), chr(10)) as f from o group by 1), b as (select sample, array_to_string(list_sort(list(distinct path || '|1|1')), chr(10)) as f from o where match_class = 'unique' group by 1)
  select sample, sha256(f) as fingerprint from a where not exists (select 1 from b where b.sample = a.sample and b.f = a.f)""")
def stale_samples(s: S, d: str) -> DataFrame:
    """Samples whose inputs are not those of their last run"""
    o = table(s, d, "observations").filter("sample is not null and matching_source is not null").select("sample", F.col("matching_source").alias("path"), F.lit(1).alias("size"), F.lit(1).alias("modified"), "match_class")
    none = s.createDataFrame([], "sample string, fingerprint string")
    finished = windows.stale(o.filter("match_class = 'unique'").drop("match_class").distinct(), none)
    return windows.stale(o.drop("match_class").distinct(), finished)


@query("select 'first' as step, count(*) as rows, true as computed from customer union all select 'again', count(*), false from customer union all select 'sources changed', count(*), true from nation union all select 'over the bound', count(*), true from nation")
def kept_statistics(s: S, d: str) -> DataFrame:
    """Tables kept under their inputs' fingerprint, and computed again when these change or the bound is met"""
    store, out = evidence.Snapshots(s, new_path(s)), []
    for step, key, version, name in (("first", "a", "v1", "customer"), ("again", "a", "v1", "nation"), ("sources changed", "a", "v2", "nation"), ("over the bound", "b", "v1", "nation")):
        ran: list[str] = []
        if step == "over the bound":
            store.most = 1
            store.seal("other", "v1", table(s, d, "region"))
            store.seal(key, version, table(s, d, "nation"))
            store.seal("third", "v1", table(s, d, "region"))
        df = store.get(key, version, lambda n=name: (ran.append(n), table(s, d, n))[1])
        out.append((step, df.count(), bool(ran)))
    return s.createDataFrame(out, "step string, rows bigint, computed boolean")


@query("""with e as (select event_type as task, user_id as owner, ts from events), l as (select task, max(ts) as ts from e group by 1) select l.task, l.ts as heartbeat_at, case when l.ts >= (select max(ts) from events) - interval 90 second then 'held' else 'expired' end as state from l""")
def task_leases(s: S, d: str) -> DataFrame:
    """Tasks whose owner has been heard of within 90 seconds"""
    e = table(s, d, "events").select(F.col("event_type").alias("task"), F.col("user_id").alias("owner"), F.col("ts").alias("heartbeat_at"))
    return evidence.leases(e, e.agg(F.max("heartbeat_at")).scalar()).drop("owner")
