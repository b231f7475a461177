"""Finding and describing inputs: read pairs, results, stage reports, workbooks.

Listings are bounded and come from the file system's own interface; what is computed from them is a DataFrame
like any other. Workbooks are small by contract and parsed on the driver.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vdjloom.schemas import CHAINS
from vdjloom.sources import xls

# File endings of reads, and the endings of the two ends of a pair.
EXTENSIONS = (".fastq.gz", ".fq.gz", ".fastq", ".fq")
READ_ENDS = (("_R1", "_R2"), ("_1", "_2"), ("_j", "_v"))
MAX_FILES = 20_000
MAX_WORKBOOK, MAX_UNPACKED, MAX_CELLS = 20 * 1024**2, 100 * 1024**2, 500_000
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def list_files(spark: SparkSession, root: str, pattern: str = "", most: int = MAX_FILES) -> DataFrame:
    """(path, relative, size, modified) of the files under a folder whose path matches the regular expression, empty files
    included, in any file system Spark knows. Links are not followed. More than `most` files raise: a
    folder of inputs is chosen by a person, and the listing is held by the driver."""
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    top, rows, todo = fs.resolvePath(base).toString().rstrip("/") + "/", [], [base]
    while todo:
        for f in fs.listStatus(todo.pop()):
            if f.isSymlink():
                continue
            if f.isDirectory():
                todo.append(f.getPath())
                continue
            path = f.getPath().toString()
            if re.search(pattern, path):
                rows.append((path, path.removeprefix(top), f.getLen(), f.getModificationTime()))
                if len(rows) > most:
                    raise ValueError(f"more than {most} files; choose a smaller folder")
    df = spark.createDataFrame(sorted(rows), "path string, relative string, size bigint, ms bigint")
    return df.select("path", "relative", "size", F.timestamp_millis("ms").alias("modified"))


def read_pairs(files: DataFrame) -> DataFrame:
    """(pair_id, sample_id, r1, r2, valid, error) from a listing. A file belongs to a pair by its name without the
    read end (a trailing number stays). Pairs with a missing or doubled end, empty files, and names
    with characters other than letters, digits, '_', '.', '-' are not valid; files that are no read
    end give a row of their own. Sample ids that occur twice get a piece of their hash.
    """
    name = F.regexp_extract("relative", r"([^/]*)$", 1)
    folder = F.regexp_extract("relative", r"^(.*/)?[^/]*$", 1)
    ext = "(?i)(" + "|".join(re.escape(e) for e in EXTENSIONS) + ")$"
    f = files.select("path", "relative", "size", folder.alias("_d"), name.alias("_n")).filter(F.col("_n").rlike(ext))
    stem = F.regexp_replace("_n", ext, "")
    side = pair = None
    for a, b in READ_ENDS:
        for s, e in (("r1", a), ("r2", b)):
            p = f"(?i)^(.*){re.escape(e)}([._-][0-9]+)?$"
            hit = stem.rlike(p)
            value = F.concat(F.regexp_extract(stem, p, 1), F.regexp_extract(stem, p, 2))
            side = F.when(hit, s) if side is None else side.when(hit, s)
            pair = F.when(hit, value) if pair is None else pair.when(hit, value)
    x = f.withColumn("_side", side).withColumn("_stem", pair).withColumn("pair_id", F.concat("_d", F.coalesce("_stem", "_n")))
    n = lambda s: F.sum(F.when(F.col("_side") == s, 1).otherwise(0))
    one = lambda s: F.max(F.when(F.col("_side") == s, F.col("path")))
    g = x.groupBy("pair_id", F.col("_side").isNull().alias("_odd")).agg(n("r1").alias("_1"), n("r2").alias("_2"), one("r1").alias("r1"), one("r2").alias("r2"), F.min("size").alias("_s"), F.min(F.coalesce("_stem", "_n")).alias("_stem"))
    error = F.concat_ws("; ", F.when(F.col("_odd"), F.lit("no read end in the name")), F.when(~F.col("_odd") & ((F.col("_1") != 1) | (F.col("_2") != 1)), F.lit("an end is missing or doubled")), F.when(~F.col("_odd") & (F.col("_s") == 0), F.lit("empty file")), F.when(~F.col("pair_id").rlike(r"^[\p{L}\p{N}_.\-/]+$"), F.lit("unsupported characters")))
    twice = F.count(F.lit(1)).over(Window.partitionBy("_stem", "_odd")) > 1
    plain = F.regexp_replace("_stem", r"[^\p{L}\p{N}_.\-]", "_")
    sid = F.when(F.col("_odd"), "").when(twice, F.concat(plain, F.lit("_"), F.substring(F.sha2("pair_id", 256), 1, 8))).otherwise(plain)
    ok = lambda c, k: F.when(F.col(k) == 1, F.col(c)).otherwise("")
    return g.select("pair_id", sid.alias("sample_id"), ok("r1", "_1").alias("r1"), ok("r2", "_2").alias("r2"), (error == "").alias("valid"), error.alias("error"))


def discover_results(files: DataFrame, summary: str = r"_summary\.(csv|tsv)$", table_: str = r"(?i)\.(csv|tsv)(\.gz)?$") -> DataFrame:
    """Per folder its summary if there is one (the first by name), else every table in it; with the chain that the
    file's name or folder tells, if any."""
    d = F.regexp_extract("relative", r"^(.*/)?[^/]*$", 1)
    x = files.withColumn("folder", d).withColumn("_sum", F.col("relative").rlike(summary)).filter(F.col("_sum") | F.col("relative").rlike(table_))
    w = Window.partitionBy("folder")
    x = x.withColumn("_any", F.max("_sum").over(w)).withColumn("_rn", F.row_number().over(w.orderBy(F.desc("_sum"), "relative")))
    return x.filter(~F.col("_any") | (F.col("_sum") & (F.col("_rn") == 1))).select("folder", "path", "relative", F.when(F.col("_any"), "summary").otherwise("table").alias("kind"), path_chain(F.col("relative")).alias("chain"))


def path_chain(path: Column) -> Column:
    """The chain named in a path as a token of its own, from the end; null if none."""
    tokens = F.reverse(F.split(F.upper(path), "[^A-Z0-9]+"))
    return F.get(F.filter(tokens, lambda t: t.isin(*CHAINS)), F.lit(0))


def consolidate(entries: DataFrame) -> DataFrame:
    """(sample_key, chain, sources): valid entries of one sample and chain as one, each path once. A path that
    is known with a chain is not listed again without."""
    v = entries.filter("valid")
    known = v.filter("chain is not null").select("sample_key", F.col("path").alias("_p")).distinct()
    bare = v.filter("chain is null").join(known, (v["sample_key"] == known["sample_key"]) & (F.col("path") == F.col("_p")), "left_anti")
    return v.filter("chain is not null").unionByName(bare).groupBy("sample_key", "chain").agg(F.array_sort(F.collect_set("path")).alias("sources"))


def fastp_counts(spark: SparkSession, path: str) -> DataFrame:
    """(source, stage, metric, count, unit) from the JSON reports of the trimming stage: totals, both ends, and the
    reasons for leaving reads out. Missing numbers are null, not zero."""
    ends = "struct<total_reads: bigint>"
    schema = f"summary struct<before_filtering: {ends}, after_filtering: {ends}>, filtering_result map<string, bigint>, " + ", ".join(f"read{i}_{w}_filtering {ends}" for i in (1, 2) for w in ("before", "after"))
    j = spark.read.schema(schema).option("multiLine", True).json(path).select("*", F.col("_metadata.file_path").alias("source"))
    rows = [("raw", "total_reads", "summary.before_filtering.total_reads", "read ends"), ("fastp", "total_reads", "summary.after_filtering.total_reads", "read ends")]
    rows += [(st, f"r{i}_reads", f"read{i}_{w}_filtering.total_reads", "reads") for i in (1, 2) for st, w in (("raw", "before"), ("fastp", "after"))]
    s = F.array(*(F.struct(F.lit(a).alias("stage"), F.lit(m).alias("metric"), F.col(c).alias("count"), F.lit(u).alias("unit")) for a, m, c, u in rows))
    base = j.select("source", F.explode(s).alias("r")).select("source", "r.*")
    why = j.select("source", F.explode("filtering_result").alias("metric", "count")).filter(F.endswith("metric", F.lit("_reads"))).select("source", F.lit("fastp_filter").alias("stage"), "metric", "count", F.lit("read ends").alias("unit"))
    return base.unionByName(why)


def stage_reports(parts: list[DataFrame]) -> DataFrame:
    """Stage tables of one schema united, equal rows once, negative counts null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.withColumn("count", F.when(F.col("count") >= 0, F.col("count"))).distinct()


def reference_genes(alleles: DataFrame) -> DataFrame:
    """(segment, allele, gene, sequence_sha256); sequences of one base or none are no entries."""
    s = F.upper(F.regexp_replace(F.coalesce("sequence", F.lit("")), r"\s", ""))
    return alleles.filter(F.length(s) > 1).select("segment", "allele", F.split("allele", r"\*")[0].alias("gene"), F.sha2(s, 256).alias("sequence_sha256")).distinct()


def published_metrics(table_: DataFrame, samples: list[str], keys: tuple[str, ...] = ("sample", "batch")) -> DataFrame:
    """The selected samples of a wide metrics table as (sample, batch, metric, value); what is no finite number is null."""
    names = [c for c in table_.columns if c not in keys]
    pairs = ", ".join(f"'{n}', try_cast(`{n}` as double)" for n in names)
    x = table_.filter(F.col("sample").isin(*samples)).select(*keys, F.expr(f"stack({len(names)}, {pairs}) as (metric, value)"))
    return x.withColumn("value", F.when(~F.isnan("value") & (F.abs("value") != float("inf")), F.col("value")))


def assigned_primers(requests: DataFrame, primers: DataFrame) -> DataFrame:
    """(sample, chain, names): the primers a sample's chain may have: those given for it, for the sample, or for the chain of
    any sample. A request without any fails."""
    ok = (F.coalesce(F.col("_s") == F.col("sample"), F.col("_s").isNull())) & (F.coalesce(F.col("_c") == F.col("chain"), F.col("_c").isNull()))
    p = primers.select(F.col("sample").alias("_s"), F.col("chain").alias("_c"), "name")
    exact = requests.join(p.filter("_s is not null"), (F.col("sample") == F.col("_s")) & ok)
    general = requests.join(p.filter("_s is null and _c is not null"), F.col("chain") == F.col("_c"))
    got = exact.select("sample", "chain", "name").unionByName(general.select("sample", "chain", "name")).groupBy(F.col("sample").alias("_rs"), F.col("chain").alias("_rc")).agg(F.array_sort(F.collect_set("name")).alias("names"))
    j = requests.select("sample", "chain").distinct().join(got, (F.col("sample") == F.col("_rs")) & (F.col("chain") == F.col("_rc")), "left")
    return j.select("sample", "chain", F.coalesce("names", F.raise_error(F.concat(F.lit("no primers for "), F.col("sample"), F.lit(" "), F.col("chain"))).cast("array<string>")).alias("names"))


# --- workbooks ---------------------------------------------------------------------------------


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def read_bytes(spark: SparkSession, path: str, most: int) -> bytes:
    """A small file whole, from any file system Spark knows; larger ones raise."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen()
    if size > most:
        raise ValueError(f"{path} is larger than {most} bytes")
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def workbook(source: str | bytes, sheet: str | None = None) -> tuple[list[str], list[list[str]], list[tuple[int, int, int, int]]]:
    """(sheet names, rows of texts, merged ranges as row and column bounds) of a workbook (a local path, or its bytes), XLSX or
    XLS, by the standard library. Saved values are read, formulas are not evaluated. Files beyond the size limits raise."""
    if isinstance(source, str):
        with open(source, "rb") as f:
            source = f.read(MAX_WORKBOOK + 1)
    if len(source) > MAX_WORKBOOK:
        raise ValueError("workbook larger than 20 MiB")
    if source.startswith(xls.SIGNATURE):
        return xls.workbook(source, sheet, MAX_CELLS)
    with zipfile.ZipFile(io.BytesIO(source)) as z:
        if sum(i.file_size for i in z.infolist()) > MAX_UNPACKED:
            raise ValueError("workbook unpacks to more than 100 MiB")
        tree = lambda n: ElementTree.fromstring(z.read(n))
        shared = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in tree("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in z.namelist() else []
        sheets = {s.get("name"): s.get(_REL) for s in tree("xl/workbook.xml").iter(f"{_MAIN}sheet")}
        targets = {r.get("Id"): r.get("Target") for r in tree("xl/_rels/workbook.xml.rels")}
        name = sheet or next(iter(sheets))
        t = targets[sheets[name]].lstrip("/")
        x = tree(t if t.startswith("xl/") else f"xl/{t}")
    cells: dict[tuple[int, int], str] = {}
    for c in x.iter(f"{_MAIN}c"):
        v = c.find(f"{_MAIN}v")
        text = "".join(i.text or "" for i in c.iter(f"{_MAIN}t")) if c.get("t") == "inlineStr" else "" if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text or ""
        cells[int(re.search("[0-9]+", c.get("r")).group()) - 1, _column(c.get("r"))] = text.strip()
    height, width = (max((k[i] for k in cells), default=-1) + 1 for i in (0, 1))
    if height * width > MAX_CELLS:
        raise ValueError("sheet of more than 500,000 cells")
    merged = []
    for m in x.iter(f"{_MAIN}mergeCell"):
        a, b = m.get("ref").split(":")
        row = lambda r: int(re.search("[0-9]+", r).group())
        merged.append((row(a) - 1, row(b), _column(a), _column(b) + 1))
    return list(sheets), [[cells.get((r, c), "") for c in range(width)] for r in range(height)], merged


def cell(rows: list[list[str]], merged: list[tuple[int, int, int, int]], row: int, col: int) -> str:
    """A cell's text; a cell in a merged range has its first cell's, no other blank inherits."""
    for r0, r1, c0, c1 in merged:
        if r0 <= row < r1 and c0 <= col < c1:
            row, col = r0, c0
            break
    return rows[row][col] if row < len(rows) and col < len(rows[row]) else ""


def sheet_table(spark: SparkSession, path: str, sheet: str | None = None, header: int = 0) -> DataFrame:
    """A sheet as a DataFrame of texts with row_number; columns by the header row, blank rows left out, merged cells
    filled. Of columns with one name the last counts."""
    _, rows, merged = workbook(read_bytes(spark, path, MAX_WORKBOOK), sheet)
    names = [cell(rows, merged, header, c) for c in range(len(rows[header]) if rows else 0)]
    at = {n: c for c, n in enumerate(names) if n}
    out = [(r, *(cell(rows, merged, r, c) for c in at.values())) for r in range(header + 1, len(rows))]
    return spark.createDataFrame([x for x in out if any(x[1:])], "row_number int, " + ", ".join(f"`{n}` string" for n in at))
