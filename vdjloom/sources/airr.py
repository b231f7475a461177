"""Readers of delimited AIRR tables, sequences and states."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vdjloom.functions.headers import canonical_header, quality
from vdjloom.schemas import CHAINS


def header_of(spark: SparkSession, path: str, comment: str = "#") -> tuple[list[str], str]:
    """The column names of a delimited file (of the first of several), and its delimiter: a tab if the header has
    one, else a comma. Comment lines before the header are skipped, a byte order mark is dropped."""
    line = spark.read.text(path).filter((F.col("value") != "") & ~F.startswith("value", F.lit(comment))).first()
    if line is None:
        raise ValueError(f"no header in {path}")
    text = line[0].lstrip("﻿")
    sep = "\t" if "\t" in text else ","
    return [c.strip().strip('"') for c in text.split(sep)], sep


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, required: list[str] | None = None, on_ragged: str = "pad", comment: str | None = "#", lines_in_fields: bool = False) -> DataFrame:
    """A CSV or TSV (plain or gzip) with header, all columns strings.

    columns: only these are read (null where the file has none of that name). Of columns
    with one name the last counts. on_ragged: pad gives short rows nulls; error fails on rows
    whose number of fields differs. Missing required columns raise. A quote within quotes is doubled;
    an empty field is null, a pair of quotes an empty text.
    lines_in_fields: quoted fields may hold line ends (a file is then one task).
    """
    names, sep = header_of(spark, path, comment or "\0")
    missing = [c for c in required or [] if c not in names]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    unique = [n if n not in names[i + 1 :] else f"_dropped_{i}" for i, n in enumerate(names)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in unique])
    r = spark.read.schema(schema).option("sep", sep).option("header", True).option("enforceSchema", True).option("encoding", "UTF-8").option("escape", '"').option("nullValue", "\0").option("multiLine", lines_in_fields).option("mode", "FAILFAST" if on_ragged == "error" else "PERMISSIVE")
    df = (r.option("comment", comment) if comment else r).csv(path)
    want = columns or [n for n in unique if not n.startswith("_dropped_")]
    return df.select(*(F.col(f"`{c}`") if c in unique else F.lit(None).cast("string").alias(c) for c in want))


def read_airr(spark: SparkSession, path: str, on_ragged: str = "pad") -> DataFrame:
    """An AIRR table; needs sequence_id, v_call and locus; scores and coordinates get their types."""
    df = read_table(spark, path, required=["sequence_id", "v_call", "locus"], on_ragged=on_ragged)
    typed = {c: "double" for c in ("v_score", "v_identity")} | {f"{s}_alignment_{e}": "int" for s in "vdjc" for e in ("start", "end")}
    return df.withColumns({c: F.expr(f"try_cast(`{c}` as {t})") for c, t in typed.items() if c in df.columns})


def read_droplet(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Droplet rows with the wanted fields: umi_count stands for umi_counts, a missing count is 1, missing fields ''."""
    names, _ = header_of(spark, path)
    df = read_table(spark, path)
    if "umi_counts" not in names:
        df = df.withColumn("umi_counts", F.col("umi_count") if "umi_count" in names else F.lit("1"))
    df = df.withColumn("umi_counts", F.coalesce(F.expr("try_cast(umi_counts as bigint)"), F.lit(1).cast("bigint")))
    return df.select(*(F.coalesce(F.col(f), F.lit("")).alias(f) if f in df.columns and f != "umi_counts" else F.col(f) if f == "umi_counts" else F.lit("").alias(f) for f in fields))


COMPRESSED = (".gz", ".bgz", ".bz2", ".zst", ".xz")


def read_fastq(spark: SparkSession, path: str, stage: str = "") -> DataFrame:
    """Reads of FASTQ files: (source, stage, ordinal, title, canonical, sequence, quality, mean_quality, expected_errors,
    valid). Four lines make a record; a record whose marks or lengths do not fit has valid = false.

    Compressed files are one partition each: records are put together as their lines stream by, and nothing is
    moved. Plain files are read in blocks: lines are numbered by the place of their block in the file, and
    the lines of a record meet by its number.
    """
    text = spark.read.text(path)
    lines = text.select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("_b"), "value")
    if all(f.lower().endswith(COMPRESSED) for f in text.inputFiles()):
        rec = lines.select("source", "value").mapInArrow(_four_lines, "source string, _o bigint, t string, s string, plus string, q string")
    else:
        rec = _numbered_records(lines)
    valid = F.coalesce(F.startswith("t", F.lit("@")) & F.startswith("plus", F.lit("+")) & (F.length("s") == F.length("q")), F.lit(False))
    title = F.col("t").substr(F.lit(2), F.length("t"))
    out = rec.select("source", F.lit(stage).alias("stage"), (F.col("_o") + 1).cast("bigint").alias("ordinal"), title.alias("title"), canonical_header(title).alias("canonical"), F.upper("s").alias("sequence"), F.col("q").alias("quality"), valid.alias("valid"))
    return out.withColumn("_q", quality("quality")).select("*", "_q.mean_quality", "_q.expected_errors").drop("_q")


def _four_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every four lines of a file as one row; a file's lines come in order, one file after the other."""
    held: pa.Table | None = None
    source, n = None, 0

    def rows(t: pa.Table, name: str, first: int) -> pa.RecordBatch:
        v, k = t.column("value").combine_chunks(), -(-t.num_rows // 4)
        part = [v.take(pa.array([x if x < len(v) else None for x in range(i, 4 * k, 4)], pa.int64())) for i in range(4)]
        return pa.RecordBatch.from_arrays([pa.array([name] * k, pa.string()), pa.array(range(first, first + k), pa.int64()), *part], names=["source", "_o", "t", "s", "plus", "q"])

    for b in batches:
        t = pa.Table.from_batches([b])
        while t.num_rows:
            name = t.column("source")[0].as_py()
            if name != source:
                if held is not None and held.num_rows:
                    yield rows(held, source, n)
                held, source, n = None, name, 0
            own = pc.equal(t.column("source"), name)
            size = t.num_rows if pc.all(own).as_py() else pc.index(own, False).as_py()
            mine, t = t.slice(0, size), t.slice(size)
            held = mine if held is None else pa.concat_tables([held, mine])
            whole = held.num_rows // 4 * 4
            if whole:
                yield rows(held.slice(0, whole), source, n)
                n += whole // 4
                held = held.slice(whole)
    if held is not None and held.num_rows:
        yield rows(held, source, n)


def _numbered_records(lines: DataFrame) -> DataFrame:
    """Records of files that are read in blocks. A line's place in its partition comes with the scan; a block's lines
    follow each other there, and the scan cuts the same files in the same way each time."""
    rows = lines.withColumn("_k", F.monotonically_increasing_id())
    sizes = rows.groupBy("source", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_k").alias("_k0"))
    before = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(F.col("source").alias("_s"), F.col("_b").alias("_bb"), "_k0", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    at = rows.join(shift, (F.col("source") == F.col("_s")) & F.col("_b").eqNullSafe(F.col("_bb"))).withColumn("line", F.col("_k") - F.col("_k0") + F.col("_before"))
    pick = lambda i: F.max(F.when(F.col("line") % 4 == i, F.col("value")))
    return at.groupBy("source", F.floor(F.col("line") / 4).alias("_o")).agg(pick(0).alias("t"), pick(1).alias("s"), pick(2).alias("plus"), pick(3).alias("q"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(source, title, sequence) of FASTA files, sequences of several lines joined and upper-cased. Records are split
    by the reader at '\\n>'."""
    r = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("source"), F.regexp_replace("value", "^>", "").alias("v")).filter(F.trim("v") != "")
    parts = F.split("v", r"\r?\n", 2)
    return r.select("source", F.trim(parts[0]).alias("title"), F.upper(F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"\s", "")).alias("sequence"))


def read_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, umi) pairs; the canonical id is added."""
    return read_table(spark, path, ["read_id", "umi"]).withColumn("canonical", canonical_header("read_id", short_coordinates=True))


def read_barcodes(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq) of 8 bases A, C, G, T each; a name or a sequence used twice with another partner raises."""
    df = read_table(spark, path, ["name", "seq"]).select(F.trim("name").alias("name"), F.upper(F.trim("seq")).alias("seq")).distinct()
    bad = df.filter(~F.coalesce(F.col("seq").rlike("^[ACGT]{8}$"), F.lit(False))).limit(1).count()
    twice = df.groupBy("name").count().filter("count > 1").limit(1).count() + df.groupBy("seq").count().filter("count > 1").limit(1).count()
    if bad or twice:
        raise ValueError("barcodes: not 8 bases ACGT, or used twice")
    return df


def read_mapping_inputs(spark: SparkSession, glob: str, chains: list[str] | None = None) -> DataFrame:
    """CSVs named <sample>__<chain>.csv with their sample and chain, the unknown chains left out."""
    df = spark.read.option("header", True).option("escape", '"').csv(glob)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.+)__([A-Za-z0-9]+)\.csv(?:\.gz)?$", 1)
    chain = F.upper(F.regexp_extract(F.col("_metadata.file_name"), r"^(.+)__([A-Za-z0-9]+)\.csv(?:\.gz)?$", 2))
    return df.select("*", name.alias("sample"), chain.alias("chain")).filter(F.col("chain").isin(*(chains or CHAINS)))


def receipts(spark: SparkSession, path: str) -> DataFrame:
    """Per file its size, modification time and the SHA-256 of its first 64 KiB."""
    b = spark.read.format("binaryFile").load(path)
    return b.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2(F.substring("content", 1, 65536), 256).alias("head_sha256"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files that were added, removed or changed between two receipts."""
    b = after.select(F.col("path").alias("_p"), F.col("size").alias("_s"), F.col("head_sha256").alias("_h"))
    j = before.join(b, F.col("path") == F.col("_p"), "full")
    state = F.when(F.col("path").isNull(), "added").when(F.col("_p").isNull(), "removed").when((F.col("size") != F.col("_s")) | (F.col("head_sha256") != F.col("_h")), "changed")
    return j.select(F.coalesce("path", "_p").alias("path"), state.alias("state")).filter("state is not null")
