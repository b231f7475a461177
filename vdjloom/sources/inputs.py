"""Which tables hold a sample's rows, by the kind of pipeline that made them (S16), and the records of a submission sheet.

Every kind names its tables in its own way: in a manifest, in a summary, in summaries beside the tables, or only by file
names. What a summary says is joined with the listing of the files that are there (discovery.list_files).
All give (sample_key, sample, chain, path, chain_column, valid, error); chain_column is the column by which a table of
several chains must be filtered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vdjloom.functions.headers import barcode_name
from vdjloom.functions.text import strip
from vdjloom.operators.matching import expand_chains
from vdjloom.schemas import CHAINS
from vdjloom.sources.discovery import MAX_WORKBOOK, path_chain, read_bytes, sheet_table, workbook

TABLE = r"(?i)\.(csv|tsv)(\.gz)?$"
RECEPTORS = ("BCR", "TCR")


def confined(path: Column | str, root: str = "") -> Column:
    """A path that stays within the root: relative, or absolute below it, and without '..' as a part. False for null and ''."""
    p = F.regexp_replace(F.col(path) if isinstance(path, str) else path, r"\\", "/")
    below = ~F.startswith(p, F.lit("/")) & ~p.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    if root:
        below = below | F.startswith(p, F.lit(root.rstrip("/") + "/"))
    return F.coalesce((p != "") & below & ~p.rlike(r"(^|/)\.\.(/|$)"), F.lit(False))


def known_chain(c: Column | str) -> Column:
    """A chain in upper case; null if it is none."""
    v = F.upper(strip(c))
    return F.when(v.isin(*CHAINS), v)


def _entries(rows: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """rows: (sample_key, sample, chain, wanted, chain_column, problem); the first problem is the error."""
    f = files.select(F.col("relative").alias("_rel"), F.col("path").alias("_path"), F.col("size").alias("_size"))
    inside = F.when(F.startswith("wanted", F.lit(root.rstrip("/") + "/")), F.substring("wanted", len(root.rstrip("/")) + 2, 10_000)).otherwise(F.col("wanted")) if root else F.col("wanted")
    j = rows.withColumn("_w", inside).join(f, F.col("_w") == F.col("_rel"), "left")
    error = (
        F.when(F.col("problem") != "", F.col("problem")).when(~confined("wanted", root), "path outside the root")
        .when(F.col("_path").isNull(), "file missing").when(F.col("_size") == 0, "file empty").otherwise("")
    )
    return j.withColumn("error", error).select("sample_key", "sample", "chain", F.when(F.col("error") == "", F.col("_path")).alias("path"), "chain_column", (F.col("error") == "").alias("valid"), "error")


def _status(what: str) -> Column:
    s = F.coalesce(F.upper(strip("status")), F.lit(""))
    return F.when(s != "OK", F.concat(F.lit(f"{what} status "), F.when(s == "", "unknown").otherwise(s)))


def mapping_inputs(summary: DataFrame, files: DataFrame, stage: str, root: str = "") -> DataFrame:
    """S16, re-mapping: summary (sample_key, sample_id, chain, status, source_file); the table lies under the stage as the source
    file does, with the ending .tsv."""
    chain, source = known_chain("chain"), F.coalesce(F.col("source_file"), F.lit(""))
    problem = F.coalesce(_status("count"), F.when(chain.isNull() | ~confined(source), "no chain or source file"), F.lit(""))
    wanted = F.concat(F.lit(stage.rstrip("/") + "/"), F.regexp_replace(source, r"\.[^./]*$", ""), F.lit(".tsv"))
    return _entries(summary.select("sample_key", F.col("sample_id").alias("sample"), chain.alias("chain"), wanted.alias("wanted"), F.lit("").alias("chain_column"), problem.alias("problem")), files, root)


def locus_inputs(summary: DataFrame, files: DataFrame, root: str = "") -> DataFrame:
    """S16, tables split by locus: summary (sample_key, sample_id, chain, status, output_path, error); they are filtered by their locus column."""
    chain = known_chain("chain")
    own = F.when(F.coalesce(F.col("error"), F.lit("")) != "", F.col("error")).otherwise("split did not succeed")
    problem = F.when((F.coalesce(F.upper(strip("status")), F.lit("")) != "OK") | chain.isNull(), own).otherwise("")
    return _entries(summary.select("sample_key", F.col("sample_id").alias("sample"), chain.alias("chain"), F.coalesce("output_path", F.lit("")).alias("wanted"), F.lit("locus").alias("chain_column"), problem.alias("problem")), files, root)


def task_inputs(summary: DataFrame, files: DataFrame, root: str = "", filtered_only: bool = False) -> DataFrame:
    """S16, base pipelines: summary (pair_id, sample_id, chain, status, output_path, locus_filter_version); the key is pair and sample.
    Tables whose task has filtered the locus (version 1) are filtered by their locus column; filtered_only: others are not ready."""
    chain, inline = known_chain("chain"), F.coalesce(F.col("locus_filter_version") == "1", F.lit(False))
    pair = F.coalesce(F.col("pair_id"), F.lit(""))
    problem = F.coalesce(
        F.when(F.lit(filtered_only) & ~inline, "locus not filtered yet"), _status("mapping"), F.when(chain.isNull(), "unknown chain"), F.when(F.coalesce("output_path", F.lit("")) == "", "no output path"), F.lit("")
    )
    key = F.when(pair != "", F.concat_ws("/", pair, F.col("sample_id"))).otherwise(F.col("sample_id"))
    return _entries(summary.select(key.alias("sample_key"), F.col("sample_id").alias("sample"), chain.alias("chain"), F.coalesce("output_path", F.lit("")).alias("wanted"), F.when(inline, "locus").otherwise("").alias("chain_column"), problem.alias("problem")), files, root)


def receptor_inputs(manifest: DataFrame, files: DataFrame, stage: str, root: str = "") -> DataFrame:
    """S16, bulk runs: manifest (label, relative_sample, sample_id, status, available_receptors); each receptor of a sample has a folder
    stage/junction_peps/label/relative_sample/receptor with a table per chain. EMPTY samples without receptors give nothing."""
    status = F.coalesce(F.upper(strip("status")), F.lit(""))
    names = F.array_distinct(F.filter(F.transform(F.split(F.upper(F.coalesce("available_receptors", F.lit(""))), ","), lambda x: F.trim(x)), lambda x: x != ""))
    rel = F.coalesce(F.col("relative_sample"), F.lit(""))
    key = F.when(rel != "", F.concat_ws("/", "label", rel)).otherwise(F.col("label"))
    m = manifest.select(key.alias("sample_key"), F.col("sample_id").alias("sample"), status.alias("_st"), F.explode_outer(names).alias("_r"), rel.alias("_rel"), "label")
    m = m.filter(~((F.col("_st") == "EMPTY") & F.col("_r").isNull()))
    problem = (
        F.when(~F.col("_st").isin("OK", "EMPTY"), F.concat(F.lit("preprocessing status "), F.when(F.col("_st") == "", "unknown").otherwise(F.col("_st"))))
        .when(F.col("_r").isNull(), "no receptors listed").when(~F.col("_r").isin(*RECEPTORS) | ~confined("_rel"), "bad receptor or sample path")
    )
    m = m.withColumn("problem", problem).withColumn("_folder", F.concat_ws("/", F.lit(stage.rstrip("/") + "/junction_peps"), "label", "_rel", "_r"))
    name = F.regexp_extract("relative", r"([^/]*)$", 1)
    f = files.select("path", "size", F.regexp_extract("relative", r"^(.*)/[^/]*$", 1).alias("_d"), known_chain(F.regexp_replace(name, r"\..*$", "")).alias("_c")).filter("_c is not null")
    j = m.join(f, (F.col("_folder") == F.col("_d")) & F.col("problem").isNull(), "left")
    error = F.coalesce("problem", F.when(F.col("path").isNull(), F.concat(F.lit("no tables of "), F.col("_r"))), F.when(F.col("size") == 0, "file empty"), F.lit(""))
    # a sample's own problem comes once, whatever its receptors
    return j.withColumn("error", error).select("sample_key", "sample", F.col("_c").alias("chain"), F.when(F.col("error") == "", F.col("path")).alias("path"), F.lit("").alias("chain_column"), (F.col("error") == "").alias("valid"), "error").distinct()


def droplet_inputs(loci: DataFrame, files: DataFrame, suffix: str = ".stage8_summary.csv") -> DataFrame:
    """S16, droplet runs: each table has a summary beside it, named by its stem. loci: (summary, locus, retained), the rows of the
    summaries by their relative path; loci with a retained row count (all, where the summary does not tell). The table is filtered by locus."""
    t = files.filter(F.col("relative").rlike(TABLE) & ~F.contains(F.lower("relative"), F.lit(".stage8_summary.")))
    t = t.select("path", "size", F.regexp_replace("relative", r"\.(csv|tsv)(\.gz)?$", "").alias("_stem")).groupBy("_stem").agg(F.count(F.lit(1)).alias("_n"), F.min("path").alias("path"), F.min("size").alias("_size"))
    kept = F.coalesce(F.upper(F.col("retained")).isin("T", "TRUE", "1", "YES"), F.lit(True))
    s = loci.select("summary", F.when(kept, known_chain("locus")).alias("chain"))
    some = s.groupBy(F.col("summary").alias("_s")).agg(F.count("chain").alias("_k"))
    s = s.join(some, F.col("summary") == F.col("_s")).filter("chain is not null or _k = 0").select("summary", "chain", "_k").distinct()
    j = s.withColumn("_want", F.expr(f"left(summary, length(summary) - {len(suffix)})")).join(t, F.col("_want") == F.col("_stem"), "left")
    error = F.when(F.col("_k") == 0, "no retained locus").when(F.coalesce("_n", F.lit(0)) != 1, "not exactly one table").when(F.col("_size") == 0, "file empty").otherwise("")
    folder = F.regexp_extract("summary", r"^(?:(.*)/)?[^/]*$", 1)
    sample = F.when(folder == "", "sample").otherwise(F.regexp_extract(folder, r"([^/]*)$", 1))
    return j.withColumn("error", error).select(
        F.when(folder == "", sample).otherwise(folder).alias("sample_key"), sample.alias("sample"), "chain", F.when(F.col("error") == "", F.col("path")).alias("path"), F.lit("locus").alias("chain_column"), (F.col("error") == "").alias("valid"), "error"
    )


def folder_inputs(files: DataFrame) -> DataFrame:
    """S16, any folder: every table in it; sample and chain by the path, the chain null if it tells none."""
    t = files.filter(F.col("relative").rlike(TABLE) & ~F.col("relative").rlike(r"(?i)_summary\.(csv|tsv)$"))
    name = F.regexp_replace(F.regexp_extract("relative", r"([^/]*)$", 1), TABLE, "")
    sample = F.regexp_replace(name, f"(?i)[._-]+({'|'.join(CHAINS)})$", "")
    error = F.when(F.col("size") == 0, "file empty").otherwise("")
    key = F.concat(F.coalesce(F.regexp_extract("relative", r"^(.*/)?[^/]*$", 1), F.lit("")), sample)
    return t.select(key.alias("sample_key"), sample.alias("sample"), path_chain(F.col("relative")).alias("chain"), F.when(error == "", F.col("path")).alias("path"), F.lit("").alias("chain_column"), (error == "").alias("valid"), error.alias("error"))


def submission_records(
    spark: SparkSession, path: str, barcodes: DataFrame | None = None, sample: str = "Sample ID", barcode: str = "Barcode", dual: str = "Dual index", note: str = "Note", chain: str = "Chain", sheet: str | None = None
) -> DataFrame:
    """(sample_id, barcode, barcode_sequence, chains, database, dual_index, note) from a submission workbook.

    The header is the first row that has the sample column (names are compared without case and outer white space). A note holds until the
    next one. Rows without a sample, and repeated headers, are passed over; equal rows count once. barcodes: (name, seq) by
    plain number; a barcode that it lacks, a chain selector that means nothing, and two rows of one sample, barcode
    and database that differ fail the job. A missing sample or chain column raises. The sheet is of bounded size (500,000 cells).
    """
    plain = lambda x: " ".join(x.split()).casefold()
    _, rows, _ = workbook(read_bytes(spark, path, MAX_WORKBOOK), sheet)
    header = next((i for i, r in enumerate(rows) if plain(sample) in map(plain, r)), None)
    if header is None:
        raise ValueError(f"{path}: no column {sample!r}")
    names = {plain(n): n for n in rows[header] if n}
    if plain(chain) not in names:
        raise ValueError(f"{path}: no column {chain!r}")
    col = lambda n: strip(F.col(f"`{names[plain(n)]}`")) if plain(n) in names else F.lit("")
    t = sheet_table(spark, path, sheet, header)
    filled = F.last(F.when(F.col("note") != "", F.col("note")), ignorenulls=True).over(Window.orderBy("row_number").rowsBetween(Window.unboundedPreceding, 0))
    r = t.select("row_number", col(sample).alias("sample_id"), col(barcode).alias("_bc"), col(dual).alias("dual_index"), col(note).alias("note"), col(chain).alias("_chain"))
    r = r.withColumn("note", F.coalesce(filled, F.lit(""))).filter((F.col("sample_id") != "") & (F.lower("sample_id") != plain(sample)))
    r = r.withColumn("barcode", F.coalesce(barcode_name("_bc"), F.lit(""))).withColumn("_e", expand_chains("_chain"))
    if barcodes is not None:
        b = barcodes.select(barcode_name("name").alias("_name"), F.col("seq").alias("_seq"))
        r = r.join(b, F.col("barcode") == F.col("_name"), "left")
        lost = (F.col("_bc") != "") & F.col("_seq").isNull()
        r = r.withColumn("_seq", F.when(lost, F.raise_error(F.concat(F.lit("unknown barcode: "), F.col("_bc"))).cast("string")).otherwise(F.coalesce("_seq", F.lit(""))))
    else:
        r = r.withColumn("_seq", F.lit(""))
    text = lambda c: F.array_join(F.coalesce(F.col(c), F.raise_error(F.concat(F.lit("unknown chain: "), F.col("_chain"))).cast("array<string>")), ",")
    r = r.select("sample_id", "barcode", F.col("_seq").alias("barcode_sequence"), text("_e.audit").alias("chains"), text("_e.database").alias("database"), "dual_index", "note").distinct()
    twice = F.count(F.lit(1)).over(Window.partitionBy(F.lower("sample_id"), "barcode", "database")) > 1
    return r.withColumn("sample_id", F.when(twice, F.raise_error(F.concat(F.lit("rows differ for sample "), F.col("sample_id"))).cast("string")).otherwise(F.col("sample_id")))
