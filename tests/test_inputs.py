"""Inputs by kind of pipeline, submission sheets, manifests, checkpoints, observers."""

from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vdjloom.functions import calls as C
from vdjloom.operators import evidence, matching, stages
from vdjloom.sources import airr, inputs, sinks
from vdjloom.streaming import windows

FILES = "path string, relative string, size bigint"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_confined_paths(spark):
    paths = ["a/b.csv", "/r/a.csv", "/r2/a.csv", "a/../../b", "..", r"a\..\b", "s3://x/a", "a..b/c", "", None, "/r/../etc"]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in paths], "p string").select(inputs.confined("p", "/r")).collect()]
    assert got == [True, True, False, False, False, False, False, True, False, False, False]


def test_summary_inputs_name_their_problem(spark):
    f = spark.createDataFrame([("/r/s/a/x.tsv", "s/a/x.tsv", 5), ("/r/s/b.tsv", "s/b.tsv", 0)], FILES)
    s = spark.createDataFrame(
        [("k1", "x", "igh ", "ok", "a/x.csv"), ("k2", "y", "IGK", "OK", "b.fa.gz"), ("k3", "z", "TRA", None, "c.csv"), ("k4", "z", "XYZ", "OK", "a/x.csv"), ("k5", "z", "TRA", "OK", "../x.csv"), ("k6", "z", "TRA", "OK", "no.csv"), ("k7", "z", "TRA", "failed", "a/x.csv")],
        "sample_key string, sample_id string, chain string, status string, source_file string",
    )
    got = {r["sample_key"]: (r["valid"], r["error"], r["path"]) for r in inputs.mapping_inputs(s, f, "s").collect()}
    assert got["k1"] == (True, "", "/r/s/a/x.tsv")
    assert {k: v[1] for k, v in got.items() if k != "k1"} == {
        "k2": "file missing", "k3": "count status unknown", "k4": "no chain or source file", "k5": "no chain or source file", "k6": "file missing", "k7": "count status FAILED",
    }
    empty = spark.createDataFrame([("/r/b.tsv", "b.tsv", 0)], FILES)
    t = spark.createDataFrame([("p", "x", "TRA", "OK", "/r/b.tsv", "1"), (None, "y", "TRA", "OK", "", None), ("p", "z", "TRA", "OK", "/etc/b.tsv", "1")], "pair_id string, sample_id string, chain string, status string, output_path string, locus_filter_version string")
    assert rows(inputs.task_inputs(t, empty, "/r"), "sample_key", "chain_column", "error") == [("p/x", "locus", "file empty"), ("p/z", "locus", "path outside the root"), ("y", "", "no output path")]
    assert inputs.task_inputs(t.limit(0), empty, "/r").count() == 0


def test_receptor_and_droplet_inputs(spark):
    f = spark.createDataFrame([(f"/r/{p}", p, 3) for p in ("s/junction_peps/in/a/TCR/TRA.csv", "s/junction_peps/in/a/TCR/note.csv", "d/x.tsv", "d/x.stage8_summary.csv", "e/y.tsv", "e/y.csv")], FILES)
    m = spark.createDataFrame([("in", "a", "A", "OK", "tcr, BCR"), ("in", "b", "B", "EMPTY", ""), ("in", "c", "C", "OK", None), ("in", "d", "D", "ERROR", "TCR,BCR"), ("in", "../x", "X", "OK", "TCR")], "label string, relative_sample string, sample_id string, status string, available_receptors string")
    assert rows(inputs.receptor_inputs(m, f, "s"), "sample_key", "error") == [("in/../x", "bad receptor or sample path"), ("in/a", ""), ("in/a", "no tables of BCR"), ("in/c", "no receptors listed"), ("in/d", "preprocessing status ERROR")]
    loci = spark.createDataFrame([("d/x.stage8_summary.csv", "tra", "T"), ("d/x.stage8_summary.csv", "TRB", "F"), ("e/y.stage8_summary.csv", "IGH", None), ("g/z.stage8_summary.csv", "IGH", "F")], "summary string, locus string, retained string")
    got = inputs.droplet_inputs(loci, f)
    assert sorted((r["sample_key"], r["chain"] or "", r["error"]) for r in got.collect()) == [("d", "TRA", ""), ("e", "IGH", "not exactly one table"), ("g", "", "no retained locus")]
    assert rows(inputs.folder_inputs(f.filter("relative like 'd/%'")), "sample_key", "chain") == [("d/x", None)]


def sheet(spark, path, *more):
    sinks.write_workbook(spark, path, "S", [["note", "sample id", "BARCODE", "chain"], ["run1", "a", "BC_01", "IGH*"], ["", "b", "2", "T"], ["run2", "c", "", "7c"], *more])
    return path


def test_submission_records(spark, tmp_path):
    bc = spark.createDataFrame([("BC001", "ACGTACGT"), ("bc_2", "ACGTACGA")], "name string, seq string")
    p = sheet(spark, f"file://{tmp_path}/a.xlsx", ["", "", "9", ""], ["x", "Sample ID", "", ""], ["", "b", "2", "T"])
    with pytest.raises(PySparkException):  # b again, with the note that came before it
        inputs.submission_records(spark, p, bc).collect()
    p = sheet(spark, f"file://{tmp_path}/b.xlsx", ["run1", "b", "BC2", "t"])
    got = inputs.submission_records(spark, p, bc)
    assert rows(got, "sample_id", "barcode", "barcode_sequence", "database", "note") == [("a", "1", "ACGTACGT", "IGH", "run1"), ("b", "2", "ACGTACGA", "TRA,TRB,TRD,TRG", "run1"), ("c", "", "", "IGH,IGK,IGL,TRA,TRB,TRD,TRG", "run2")]
    with pytest.raises(PySparkException):
        inputs.submission_records(spark, sheet(spark, f"file://{tmp_path}/c.xlsx", ["", "d", "77", "T"]), bc).collect()
    with pytest.raises(PySparkException):
        inputs.submission_records(spark, sheet(spark, f"file://{tmp_path}/d.xlsx", ["", "d", "", "nothing"]), bc).collect()
    with pytest.raises(ValueError):
        inputs.submission_records(spark, p, bc, sample="Probe")
    with pytest.raises(ValueError):
        inputs.submission_records(spark, p, bc, chain="Kette")


def test_processing_manifest(spark):
    out = [("r", "a", "A", "b", "TCR", "/t", 5, 9, 4, 1, "row_contract", ""), ("r", "a", "A", "b", "BCR", "/b", 1, 9, 1, 0, "row_contract", ""), ("r", "b", "B", "b", "BCR", "/c", 0, None, 0, 0, "none", None), ("r", "c", "C", "b", "TCR", "/d", 3, 1, 0, 0, "row_contract", "bad row")]
    df = spark.createDataFrame(out, "input_root string, relative_sample string, sample string, batch string, receptor string, path string, n_rows bigint, state_total_rows bigint, state_matched_rows bigint, state_unmatched_rows bigint, umi_source string, error string")
    got = rows(stages.processing_manifest(df), "sample", "available_receptors", "tcr_path", "bcr_path", "n_rows", "state_matched_rows", "row_contract_valid", "status", "error")
    assert got == [("A", "BCR,TCR", "/t", "/b", 6, 5, "1", "OK", ""), ("B", "BCR", "", "/c", 0, 0, "0", "EMPTY", ""), ("C", "TCR", "/d", "", 3, 0, "0", "ERROR", "bad row")]
    assert stages.processing_manifest(df.limit(0)).count() == 0


def test_snapshots_are_verified(spark, tmp_path):
    store = evidence.Snapshots(spark, f"file://{tmp_path}/kept")
    assert store.load("k", "v") is None
    df = spark.createDataFrame([(1, "a"), (2, None)], "id bigint, `odd name` string")
    assert store.seal("k", "v", df).schema == df.schema
    other = evidence.Snapshots(spark, f"file://{tmp_path}/kept")
    assert sorted(map(tuple, other.load("k", "v").collect())) == [(1, "a"), (2, None)]
    assert other.load("k", "w") is None and other.load("x", "v") is None
    part = next(p for p in (tmp_path / "kept").rglob("part-*") if p.stat().st_size)
    part.write_bytes(part.read_bytes() + b"x")
    assert other.load("k", "v") is None
    assert store.get("k", "v", lambda: df.limit(1)).count() == 1 and store.load("k", "v").count() == 1


def test_resume_batches_leases_and_order(spark):
    reads = spark.createDataFrame([(s, i) for s in "ab" for i in range(1, 6)], "source string, ordinal bigint")
    kept, todo = evidence.resume_at(reads, spark.createDataFrame([("a", 3), ("a", 2)], "source string, records bigint"))
    assert rows(kept, "source", "ordinal") == [("a", 1), ("a", 2), ("a", 3)] and todo.count() == 7
    with pytest.raises(PySparkException):
        evidence.resume_at(reads, spark.createDataFrame([("a", 9)], "source string, records bigint"))[1].collect()
    assert [len(b) for b in evidence.batches(reads, 4)] == [4, 4, 2] and list(evidence.batches(reads.limit(0))) == []
    now = datetime(2026, 1, 1)
    c = spark.createDataFrame([("t", "x", now - timedelta(seconds=200)), ("t", "y", now - timedelta(seconds=90)), ("u", "x", now - timedelta(seconds=91)), ("v", "z", None)], "task string, owner string, heartbeat_at timestamp_ntz")
    assert rows(evidence.leases(c, F.lit(now).cast("timestamp_ntz")), "task", "owner", "state") == [("t", "y", "held"), ("u", "x", "expired"), ("v", "z", "expired")]
    t = spark.createDataFrame([("a", 1), ("b", 9), ("c", None), ("d", 9)], "k string, n bigint")
    assert rows(matching.largest_first(t, "n", ["k"]), "task_order", "k") == [(1, "b"), (2, "d"), (3, "a"), (4, "c")]


def test_observer(spark, tmp_path):
    p = tmp_path / "x.tsv"
    path = f"file://{p}"
    assert windows.observe(spark, path)["status"] == "observed"  # nothing is there yet
    p.write_text("sequence_id\tn\nA\t1\nB\t")
    s = windows.observe(spark, path, expected=100, now=0.0)
    assert (s["rows"], s["columns"], s["status"], s["pending"]) == (1, 2, "observed", b"B\t")
    for k in range(1, 5):
        with p.open("a") as f:
            f.write("2\n" + "".join(f"C\t{i}\n" for i in range(14)) + "D\t")
        s = windows.observe(spark, path, s, expected=100, now=10.0 * k)
    assert s["rows"] == 61 and s["eta"] == (26, 26)
    assert windows.observe(spark, path, s, expected=100, now=50.0, chunk=2)["rows"] == 61
    with p.open("a") as f:
        f.write("3\nE\t1\t2\n")
    assert windows.observe(spark, path, s)["status"] == "unavailable"
    p.write_text("no\theader\n")
    assert windows.observe(spark, path)["status"] == "unavailable" and windows.observe(spark, path, s)["status"] == "unavailable"
    p.write_text("sequence_id\n" + "A\n" * 5)
    step = windows.observe(spark, path, chunk=8)
    assert step["status"] == "catching_up" and windows.observe(spark, path, step, expected=2)["status"] == "unavailable"


def test_functions_in_sql_are_those_of_columns(spark):
    C.register_functions(spark)
    names = ["IGHV3-23*01", "ighv10-2", "IGHG4", "IGKJ1-2", "TRBJ2", "", None, "X123456789012345Y2", "TRAC*01", "\\odd'"]
    df = spark.createDataFrame([(n, s) for n in names for s in ("V", "J", "C", "D", None)], "gene string, segment string")
    got = df.select("gene", "segment", C.natural_order("gene").alias("o"), C.gene_family("gene", "segment").alias("f"), F.expr("gene_order(gene)").alias("o2"), F.expr("gene_family(gene, segment)").alias("f2")).collect()
    assert [r for r in got if r["o"] != r["o2"] or r["f"] != r["f2"]] == []
    calls = ["IGHV1*01, IGHV2*02", "IGHV1;-", None, "", " NA ", "IGHV1*01　", "n/a,IGHV2"]
    df = spark.createDataFrame([(c, g) for c in calls for g in ("IGHV1", "IGHV2", "NA", "-", "")], "call string, gene string")
    assert df.filter(F.expr("gene_has(call, gene)") != F.array_contains(C.calls("call"), F.col("gene"))).count() == 0


def test_quotes_line_ends_and_outer_blanks_survive(spark, tmp_path):
    odd = ['say ""x""', 'a "b", c', " lead", "trail ", "back\\", 'back\\"q', "two\nlines", "", None, "tab\there", "'='", "#no comment"]
    df = spark.createDataFrame(list(enumerate(odd)), "id bigint, t string")
    sinks.write_csv(df, f"{tmp_path}/c")
    got = airr.read_table(spark, f"{tmp_path}/c", comment=None, lines_in_fields=True)
    assert {int(r["id"]): r["t"] for r in got.collect()} == dict(enumerate(odd))


def test_named_files(spark, tmp_path):
    df = spark.createDataFrame([("a b%.csv", 1), ("ü.csv", 2), ("a b%.csv", 3)], "name string, x bigint")
    assert sinks.write_named(df, f"file://{tmp_path}/n", "name") == 2
    assert sorted(p.name for p in (tmp_path / "n").iterdir() if not p.name.startswith(".")) == ["a b%.csv", "ü.csv"]
    assert (tmp_path / "n" / "ü.csv").read_text() == "x\n2\n"
    assert sinks.write_named(df.filter("x = 2").withColumn("x", F.lit(5)), f"file://{tmp_path}/n", "name") == 1
    assert (tmp_path / "n" / "ü.csv").read_text() == "x\n5\n"
    with pytest.raises(ValueError):
        sinks.write_named(df, f"file://{tmp_path}/m", "name", most=1)


def test_plain_reads_in_many_blocks(spark, tmp_path):
    """A file that is cut in the middle of records, qualities that begin with '@', and a last record that is not whole."""
    with open(tmp_path / "r.fastq", "w") as f:
        for i in range(3000):
            f.write(f"@R{i}\n{'ACGT' * (1 + i % 5)}\n+\n{'@III' * (1 + i % 5)}\n")
        f.write("@last\nAC\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        got = airr.read_fastq(spark, str(tmp_path / "r.fastq")).orderBy("ordinal").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r["ordinal"], r["title"]) for r in got[:-1]] == [(i + 1, f"R{i}") for i in range(3000)] and all(r["valid"] for r in got[:-1])
    assert got[-1]["title"] == "last" and not got[-1]["valid"]


def test_streamed_reads_of_many_files(spark, tmp_path):
    import gzip

    for k in range(5):
        with gzip.open(tmp_path / f"{k}.fastq.gz", "wt") as f:
            f.write("".join(f"@{k}_{i}\nAC\n+\nII\n" for i in range(25_000 if k == 2 else k)) + ("@half\nAC\n" if k == 3 else ""))
    got = airr.read_fastq(spark, str(tmp_path / "*.gz"))
    assert got.count() == 25_000 + 0 + 1 + 3 + 1 + 4
    assert got.filter("valid and title <> concat(regexp_extract(source, '([0-9]).fastq', 1), '_', ordinal - 1)").count() == 0
    assert [r["title"] for r in got.filter("not valid").collect()] == ["half"]
