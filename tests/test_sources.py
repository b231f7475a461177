import gzip

import pytest
from pyspark.sql import functions as F

from vdjloom.plans.durable import settle, shared_dir
from vdjloom.sources import airr, sinks
from vdjloom.sources.tables import once
from vdjloom.streaming import windows


def test_read_table(spark, tmp_path):
    p = tmp_path / "a.tsv"
    p.write_text("# note\nsequence_id\tv_call\tlocus\tv_score\n1\tV\tIGH\t200\n2\tV\tIGK\n", encoding="utf-8")
    rows = airr.read_airr(spark, str(p)).orderBy("sequence_id").collect()
    assert [r["v_score"] for r in rows] == [200.0, None]
    assert airr.read_table(spark, str(p), ["locus", "other"]).columns == ["locus", "other"]
    with pytest.raises(ValueError):
        airr.read_table(spark, str(p), required=["c_call"])


def test_last_duplicate_header_wins_and_bom(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("﻿x,y,x\n1,2,3\n", encoding="utf-8")
    assert [tuple(r) for r in airr.read_table(spark, str(p), ["x", "y"]).collect()] == [("3", "2")]


def test_droplet_defaults(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("barcode,umi_count\nA,5\nB,\n")
    assert [tuple(r) for r in airr.read_droplet(spark, str(p), ["barcode", "locus", "umi_counts"]).orderBy("barcode").collect()] == [("A", "", 5), ("B", "", 1)]


def test_fastq_and_fasta(spark, tmp_path):
    with gzip.open(tmp_path / "r.fastq.gz", "wt") as f:
        for i in range(50):
            f.write(f"@A:1:F:1:00{i}:2:3 x\nacgt\n+\nIIII\n" if i != 7 else "@bad\nACGT\n+\nIII\n")
    got = airr.read_fastq(spark, str(tmp_path / "r.fastq.gz"), "raw_R1").orderBy("ordinal").collect()
    assert [r["ordinal"] for r in got] == list(range(1, 51)) and [r["ordinal"] for r in got if not r["valid"]] == [8]
    assert got[3]["canonical"] == "A:1:F:1:3:2:3" and got[0]["sequence"] == "ACGT" and got[0]["mean_quality"] == 40.0
    (tmp_path / "s.fasta").write_text(">one x\nAC\ngt\n>two\nTT\n")
    assert [(r["title"], r["sequence"]) for r in airr.read_fasta(spark, str(tmp_path / "s.fasta")).orderBy("title").collect()] == [("one x", "ACGT"), ("two", "TT")]


def test_barcodes(spark, tmp_path):
    p = tmp_path / "b.csv"
    p.write_text("name,seq\nBC1,ACGTACGT\nBC2,ACGTACGA\n")
    assert airr.read_barcodes(spark, str(p)).count() == 2
    p.write_text("name,seq\nBC1,ACGTACGT\nBC1,ACGTACGA\n")
    with pytest.raises(ValueError):
        airr.read_barcodes(spark, str(p))


def test_receipts(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "b.txt").write_text("y")
    before = spark.createDataFrame(airr.receipts(spark, str(tmp_path / "*.txt")).collect())
    (tmp_path / "a.txt").write_text("z")
    after = airr.receipts(spark, str(tmp_path / "*.txt"))
    assert [(r["path"].rsplit("/", 1)[1], r["state"]) for r in airr.changed(before, after).collect()] == [("a.txt", "changed")]


def test_mapping_inputs_and_fasta(spark, tmp_path):
    (tmp_path / "S1__IGH.csv").write_text("cdr3_aa,copy,sequence\nCAR_x,11,ACGT\nCAS,3,nan\n")
    (tmp_path / "S1__XYZ.csv").write_text("cdr3_aa,copy,sequence\nCAR,11,ACGT\n")
    df = airr.read_mapping_inputs(spark, str(tmp_path / "*.csv"))
    assert {(r["sample"], r["chain"]) for r in df.collect()} == {("S1", "IGH")}
    out = sinks.mapping_fasta(df.withColumn("row", F.lit(0)), "row").collect()
    assert [r["value"] for r in out] == [">0_CAR_x_11\nACGT"]
    r = spark.createDataFrame([("0_CAR_x_11",), ("x_1_2",)], "h string").select(sinks.split_mapping_header("h").alias("p")).select("p.*").collect()
    assert [tuple(x) for x in r] == [(0, "CAR_x", 11), (None, None, None)]


def test_csv_sink(spark, tmp_path):
    df = spark.createDataFrame([("=1", 1), ("ok", 2)], "a string, b int")
    sinks.write_csv(df, str(tmp_path / "out"), ["b", "a", "c"])
    rows = spark.read.option("header", True).csv(str(tmp_path / "out")).orderBy("b").collect()
    assert [tuple(r) for r in rows] == [("1", "'=1", None), ("2", "ok", None)]
    sinks.write_csv(df.withColumn("k", F.lit("x")), str(tmp_path / "part"), partition_by=["k"])
    assert (tmp_path / "part" / "k=x").is_dir()
    sinks.write_text(df, sinks.fasta("a", F.lit("ACGTAC"), 4), str(tmp_path / "fa"))
    assert ">ok\nACGT\nAC" in "\n".join(r[0] for r in spark.read.text(str(tmp_path / "fa"), wholetext=True).collect())


def test_settle_and_once(spark):
    assert shared_dir(spark) == shared_dir(spark)
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (None, "a", 1), (None, "b", 1)], "id bigint, x string, loaded int")
    assert settle(once(df, "id", "x")).count() == 3
    assert settle(df.filter("id = 9")).count() == 0


def test_follow_takes_up_where_it_stopped(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for n in (3, 5):
        spark.range(n).write.mode("append").parquet(src)
        windows.follow(spark, src, "id bigint", out, cp, lambda s: s.withColumn("x", F.col("id") * 2)).awaitTermination(60)
    assert spark.read.parquet(out).count() == 8


def test_completion_and_fingerprints(spark):
    exp = spark.createDataFrame([("s", "IGH"), ("s", "TRA"), ("t", "IGH")], "sample string, chain string")
    done = spark.createDataFrame([("s", "IGH"), ("t", "IGH")], "sample string, chain string")
    assert [r[0] for r in windows.complete_samples(done, exp).collect()] == ["t"]
    inp = spark.createDataFrame([("s", "/a", 1, 1), ("t", "/b", 1, 1)], "sample string, path string, size bigint, modified bigint")
    none = spark.createDataFrame([], "sample string, fingerprint string")
    first = windows.stale(inp, none)
    assert first.count() == 2
    assert windows.stale(inp, spark.createDataFrame(first.filter("sample = 's'").collect())).select("sample").collect()[0][0] == "t"
