"""Writers and export projections."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vdjloom.functions.text import strip
from vdjloom.plans.durable import new_path

# Columns of the public chart tables that hold numbers.
NUMERIC = (
    "count", "unique_count", "ambiguous_count", "denominator", "percent", "reduction", "retention_percent", "value",
    "multiple_count", "unmatched_count", "total_count", "classified_count", "coverage_percent", "mean_shm_percent", "shared_cdr3_percent",
)


def guarded(c: Column | str) -> Column:
    """A text a spreadsheet would take for a formula gets a leading apostrophe."""
    v = F.col(c) if isinstance(c, str) else c
    return F.when(v.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), v)).otherwise(v)


def export_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly these columns in this order (null where missing), texts guarded."""
    kinds = dict(df.dtypes)
    return df.select(*((guarded(c).alias(c) if kinds[c] == "string" else F.col(c)) if c in kinds else F.lit(None).cast("string").alias(c) for c in columns))


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, sep: str = ",", partition_by: list[str] | None = None, compression: str = "none") -> None:
    """A directory of CSV parts with header; Spark's commit protocol publishes it at once. Outer white space stays, quotes
    within quotes are doubled, null is empty and an empty text is a pair of quotes."""
    w = export_table(df, columns or df.columns).write.mode("overwrite").option("header", True).option("sep", sep).option("compression", compression)
    w = w.option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    (w.partitionBy(*partition_by) if partition_by else w).csv(path)


def write_lines(df: DataFrame, path: str, head: list[str], sep: str = "\t", compression: str = "none") -> None:
    """A directory of delimited parts of text columns, each with the `head` lines (comments) and a header before its rows, as mapping
    programs write them. Nulls are empty; values must not hold the delimiter or line ends."""
    names = sep.join(df.columns)
    line = F.concat_ws(sep, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)).alias("value")

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("value", pa.string())])
        yield pa.RecordBatch.from_arrays([pa.array([*head, names])], schema=schema)
        for b in batches:
            yield pa.RecordBatch.from_arrays(b.columns, schema=schema)

    df.select(line).mapInArrow(headed, "value string").write.mode("overwrite").option("compression", compression).text(path)


def write_named(df: DataFrame, folder: str, name: str, columns: list[str] | None = None, sep: str = ",", most: int = 20_000) -> int:
    """A CSV file of its own for each value of the column `name`, which is the file's name; tells how many.
    All files are written aside and moved into the folder one by one when they are complete. More than `most` names raise."""
    spark = df.sparkSession
    keep = columns or [c for c in df.columns if c != name]
    aside = new_path(spark)
    out = export_table(df, [*keep, name]).withColumn("_name", F.col(name)).select(*keep, "_name")
    w = out.repartition("_name").write.mode("overwrite").option("header", True).option("sep", sep).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    w.partitionBy("_name").csv(aside)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(folder))
    n = 0
    for d in fs.listStatus(path(aside)):
        if not d.isDirectory():
            continue
        n += 1
        if n > most:
            raise ValueError(f"more than {most} files")
        value = unquote(d.getPath().getName().split("=", 1)[1])
        parts = [f.getPath() for f in fs.listStatus(d.getPath()) if f.getPath().getName().startswith("part-")]
        target = path(folder, value)
        fs.delete(target, False)
        if len(parts) != 1 or not fs.rename(parts[0], target):
            raise ValueError(f"{value} could not be published")
    return n


def write_workbook(spark: SparkSession, path: str, sheet: str, rows: list[list[str]], merged: list[str] | None = None) -> None:
    """A workbook of one sheet of texts with merged ranges (such as A2:A3); for tables of a few thousand cells."""
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def at(r: int, c: int) -> str:
        letters = ""
        while c >= 0:
            letters, c = chr(65 + c % 26) + letters, c // 26 - 1
        return f"{letters}{r + 1}"

    cells = "".join(
        f'<row r="{r + 1}">' + "".join(f'<c r="{at(r, c)}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for c, v in enumerate(row) if v is not None) + "</row>" for r, row in enumerate(rows)
    )
    ranges = "".join(f'<mergeCell ref="{m}"/>' for m in merged or [])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData>{cells}</sheetData>{f"<mergeCells>{ranges}</mergeCells>" if ranges else ""}</worksheet>')
    write_bytes(spark, path, out.getvalue())


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file, in any file system Spark knows; it is there whole or not at all."""
    p = spark._jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark._jsc.hadoopConfiguration())
    aside = p(path + ".part")
    f = fs.create(aside, True)
    try:
        f.write(data)
    finally:
        f.close()
    fs.delete(p(path), False)
    if not fs.rename(aside, p(path)):
        raise ValueError(f"{path} could not be published")


def fasta(header: Column | str, sequence: Column | str, width: int = 0) -> Column:
    """One FASTA record; width > 0 wraps the sequence."""
    s = F.col(sequence) if isinstance(sequence, str) else sequence
    h = F.col(header) if isinstance(header, str) else header
    body = F.rtrim(F.regexp_replace(s, f"(.{{{width}}})", "$1\n"), F.lit("\n")) if width else s
    return F.concat(F.lit(">"), h, F.lit("\n"), body)


def write_text(df: DataFrame, record: Column, path: str) -> None:
    df.select(record.alias("value")).write.mode("overwrite").text(path)


def clone_export(top: DataFrame, keys: list[str]) -> DataFrame:
    """The ranked clones with percentages as texts of 8 decimals."""
    f = lambda c: F.format_string("%.8f", c)
    return top.select(*keys, "rank", guarded("v_call").alias("v_call"), guarded("j_call").alias("j_call"), guarded("cdr3_aa").alias("cdr3_aa"), "record_count", f("frequency_percent").alias("frequency_percent"), f("cumulative_frequency_percent").alias("cumulative_frequency_percent"))


def chart_table(df: DataFrame, allowed: list[str]) -> DataFrame:
    """Only the allowed columns; numbers that are not finite or no numbers become null."""
    def clean(c: str) -> Column:
        if c not in NUMERIC:
            return F.col(c)
        d = F.expr(f"try_cast(`{c}` as double)")
        return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d).alias(c)

    return df.select(*(clean(c) for c in df.columns if c in allowed))


def mapping_header(row: Column, cdr3: Column, copies: Column) -> Column:
    """row_cdr3_copies; null where the CDR3 is blank or has white space or '>', or the count is blank or has '_'."""
    bad = F.coalesce(cdr3.rlike(r"[\s>]") | (cdr3 == "") | copies.rlike(r"[\s>_]") | (copies == ""), F.lit(True))
    return F.when(~bad, F.concat_ws("_", row.cast("string"), cdr3, copies))


def split_mapping_header(header: Column | str) -> Column:
    """struct(row, cdr3, copies) back: cut at the first and the last '_'; nulls if it does not fit."""
    h = F.col(header) if isinstance(header, str) else header
    p = r"^(\d+)_(.+)_([^_]+)$"
    ok = h.rlike(p)
    part = lambda i: F.when(ok, F.regexp_extract(h, p, i))
    return F.struct(part(1).cast("bigint").alias("row"), part(2).alias("cdr3"), F.when(part(3).rlike(r"^\d+$"), part(3)).cast("bigint").alias("copies"))


def mapping_fasta(df: DataFrame, order: str, cdr3: str = "cdr3_aa", copies: str = "copy", sequence: str = "sequence") -> DataFrame:
    """The FASTA records of a mapping table; rows whose sequence is blank or nan are skipped, sequences that
    are not IUPAC nucleotides fail the job."""
    s = strip(sequence)
    rows = df.filter(s.isNotNull() & ~F.lower(s).isin("", "nan"))
    checked = F.when(s.rlike("^[ACGTRYSWKMBDHVNUacgtryswkmbdhvnu]+$"), s).otherwise(F.raise_error(F.concat(F.lit("not nucleotides: "), s)))
    return rows.select(fasta(mapping_header(F.col(order), F.col(cdr3), F.col(copies).cast("string")), checked).alias("value"))


def covered_export(primer_rows: DataFrame, sample_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Primer rows, and the sample rows whose keys no primer row covers, each once."""
    rest = sample_rows.join(primer_rows.select(*keys).distinct(), keys, "left_anti")
    return primer_rows.unionByName(rest).distinct()


def receptor(locus: Column | str) -> Column:
    """TCR or BCR by locus."""
    v = F.upper(F.col(locus) if isinstance(locus, str) else locus)
    return F.when(F.startswith(v, F.lit("TR")), "TCR").when(F.startswith(v, F.lit("IG")), "BCR")
