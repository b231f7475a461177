import json
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vdjloom.operators import evidence
from vdjloom.sources import discovery as D


def test_read_pairs(spark, tmp_path):
    for n in ("a/x_R1.fq.gz", "a/x_R2.fq.gz", "b/x_R1.fq.gz", "b/x_R2_001.fq.gz", "c/y_1.fastq", "c/y_2.fastq", "c/odd.fq", "c/note.txt"):
        p = tmp_path / n
        p.parent.mkdir(exist_ok=True)
        p.write_text("" if n == "c/y_2.fastq" else "x")
    files = D.list_files(spark, str(tmp_path))
    assert files.count() == 8
    got = {r["pair_id"]: r for r in D.read_pairs(files).collect()}
    assert set(got) == {"a/x", "b/x", "b/x_001", "c/y", "c/odd.fq"}
    assert got["a/x"]["valid"] and got["a/x"]["r1"].endswith("x_R1.fq.gz") and got["a/x"]["sample_id"].startswith("x_")
    assert got["c/y"]["error"] == "empty file" and got["b/x"]["error"] == "an end is missing or doubled" and got["c/odd.fq"]["error"] == "no read end in the name"


def test_results_and_consolidation(spark, tmp_path):
    for n in ("p/chain_summary.csv", "p/S1__IGH.csv", "q/S2.IGK.tsv", "q/S2.tsv"):
        p = tmp_path / n
        p.parent.mkdir(exist_ok=True)
        p.write_text("x")
    got = sorted((r["relative"], r["kind"], r["chain"]) for r in D.discover_results(D.list_files(spark, str(tmp_path))).collect())
    assert got == [("p/chain_summary.csv", "summary", None), ("q/S2.IGK.tsv", "table", "IGK"), ("q/S2.tsv", "table", None)]
    e = spark.createDataFrame([("s", "IGH", "/1", True), ("s", None, "/1", True), ("s", "IGH", "/2", True), ("s", None, "/3", True), ("s", "IGH", "/4", False)], "sample_key string, chain string, path string, valid boolean")
    assert {(r["chain"], tuple(r["sources"])) for r in D.consolidate(e).collect()} == {("IGH", ("/1", "/2")), (None, ("/3",))}


def test_fastp_counts(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"summary": {"before_filtering": {"total_reads": 10}, "after_filtering": {"total_reads": 8}}, "filtering_result": {"low_quality_reads": 2, "other": 1}, "read1_before_filtering": {"total_reads": 5}}))
    got = {(r["stage"], r["metric"]): r["count"] for r in D.stage_reports([D.fastp_counts(spark, str(tmp_path / "*.json"))]).collect()}
    assert got == {("raw", "total_reads"): 10, ("fastp", "total_reads"): 8, ("raw", "r1_reads"): 5, ("fastp", "r1_reads"): None, ("raw", "r2_reads"): None, ("fastp", "r2_reads"): None, ("fastp_filter", "low_quality_reads"): 2}


def test_reference_and_metrics(spark):
    a = spark.createDataFrame([("V", "A*01", "acgt"), ("V", "A*02", "A"), ("V", "A*01", "acgt")], "segment string, allele string, sequence string")
    assert [r["gene"] for r in D.reference_genes(a).collect()] == ["A"]
    t = spark.createDataFrame([("s", "b", "1.5", "nan"), ("t", "b", "2", "3")], "sample string, batch string, x string, y string")
    assert sorted((r["metric"], r["value"]) for r in D.published_metrics(t, ["s"]).collect()) == [("x", 1.5), ("y", None)]


def test_assigned_primers(spark):
    p = spark.createDataFrame([("s", "IGH", "g", "p1", "A"), ("s", None, "g", "p2", "C"), (None, "IGH", "g", "p3", "G"), ("t", "TRB", "g", "p4", "T")], "sample string, chain string, grp string, name string, sequence string")
    r = spark.createDataFrame([("s", "IGH")], "sample string, chain string")
    assert D.assigned_primers(r, p).first()["names"] == ["p1", "p2", "p3"]
    with pytest.raises(PySparkException):
        D.assigned_primers(spark.createDataFrame([("u", "TRA")], "sample string, chain string"), p).collect()


def write_workbook(path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>group</t></si><si><t>na</t></si><si><r><t>me</t></r></si></sst>")
        rows = '<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>name</t></is></c></row><row><c r="A2" t="inlineStr"><is><t>G</t></is></c><c r="B2" t="s"><v>1</v></c></row><row><c r="B3"><v>7</v></c></row><row><c r="B4"><v>8</v></c></row>'
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData>{rows}</sheetData><mergeCells><mergeCell ref="A2:A3"/></mergeCells></worksheet>')


def test_workbook(spark, tmp_path):
    p = str(tmp_path / "w.xlsx")
    write_workbook(p)
    names, rows, merged = D.workbook(p)
    assert names == ["One"] and rows[0] == ["group", "name"] and merged == [(1, 3, 0, 1)]
    got = [tuple(r) for r in D.sheet_table(spark, p).orderBy("row_number").collect()]
    assert got == [(1, "G", "na"), (2, "G", "7"), (3, "", "8")]


def test_published_and_composition_source(spark):
    runs = spark.createDataFrame([("a", "DONE"), ("b", "DONE"), ("c", "RUNNING")], "run_id string, state string")
    rec = spark.createDataFrame([(x, "/f", 1, "h" if x != "b" else "other") for x in "abc"], "run_id string, path string, size bigint, sha256 string")
    now = spark.createDataFrame([("/f", 1, "h")], "path string, size bigint, sha256 string")
    assert {r["run_id"]: r["published"] for r in evidence.published(runs, rec, now).collect()} == {"a": True, "b": False, "c": False}
    items = spark.createDataFrame([("s", "IGH", "f", "/1"), ("t", "IGH", "f", "/2"), ("t", "IGH", "g", "/3"), ("u", "IGH", None, "/4"), ("v", "IGH", "f", "/5"), ("w", "IGH", "x", "/6")], "sample string, chain string, folder string, path string")
    man = spark.createDataFrame([("f", "s", "IGH", "OK", "/1"), ("f", "v", "IGH", "OK", "/9")], "folder string, sample string, chain string, status string, path string")
    done = spark.createDataFrame([("f", True), ("g", True)], "folder string, published boolean")
    assert {r["sample"]: r["status"] for r in evidence.composition_source(items, man, done).collect()} == {
        "s": "complete", "t": "multiple_preprocessing_sources", "u": "preprocessing_source_unavailable", "v": "preprocessing_scope_unverified", "w": "preprocessing_unavailable",
    }


def test_composition_source_needs_one_row_and_its_output(spark):
    items = spark.createDataFrame([("s", "IGH", "f", "/1"), ("s", "IGH", "f", "/2"), ("t", "IGH", "f", "/3"), ("u", "IGH", "f", "/4"), ("u", "IGH", "f", "/5")], "sample string, chain string, folder string, path string")
    rows = [("f", "s", "IGH", "OK", "/1", 1), ("f", "s", "IGH", "OK", "/2", 2), ("f", "t", "IGH", "OK", "/3", 3), ("f", "u", "IGH", "OK", "/4", 4), ("f", "u", "IGH", "OK", "/5", 4), ("f", "u", "IGK", "OK", "/6", 4)]
    man = spark.createDataFrame(rows, "folder string, sample string, chain string, status string, path string, row int")
    done = spark.createDataFrame([("f", True)], "folder string, published boolean")
    out = [("f", "t", "IGH", 5, 7, 5, 8), ("f", "u", "IGH", 5, 7, 5, 7)]
    out = spark.createDataFrame(out, "folder string, sample string, chain string, size bigint, modified bigint, receipt_size bigint, receipt_modified bigint")
    status = lambda *a: {r["sample"]: r["status"] for r in evidence.composition_source(*a).collect()}
    assert status(items, man, done, out) == {"s": "preprocessing_sample_unverified", "t": "preprocessing_output_unverified", "u": "complete"}
    joined = spark.createDataFrame([("f", "s", "IGH", "OK", "/1;/2")], "folder string, sample string, chain string, status string, path string")
    assert status(items.filter("sample = 's'"), man.drop("row"), done) == {"s": "preprocessing_sample_unverified"}
    assert status(items.filter("sample = 's'"), joined, done) == {"s": "complete"}


def test_task_plan(spark):
    s = spark.createDataFrame([("S 1", "p", "igh", "OK", "/1"), ("S 1", "p", "IGH", "OK", "/2"), ("s_1", "q", "IGK", "OK", "/3"), ("x", "p", "TRA", "ERROR", "/4")], "sample_id string, pair_id string, chain string, status string, output_path string")
    good = s.filter("status = 'OK'")
    got = evidence.task_plan(good).collect()
    assert len(got) == 2 and len({r["label"] for r in got}) == 2 and {len(r["sources"]) for r in got} == {1, 2}
    with pytest.raises(PySparkException):
        evidence.task_plan(s).collect()
    with pytest.raises(ValueError):
        evidence.task_plan(good, spark.createDataFrame([("S 1", "p", "TRG")], "sample_id string, pair_id string, chain string"))


def test_preview_pages_and_versions(spark):
    df = spark.createDataFrame([(i, "OK" if i % 2 else "ERROR", f"row {i}") for i in range(7)], "id bigint, status string, note string")
    rows, cur = evidence.preview(df, "id", "v1", size=3)
    rows2, cur2 = evidence.preview(df, "id", "v1", cur, size=3)
    rows3, end = evidence.preview(df, "id", "v1", cur2, size=3)
    assert [r["id"] for r in rows + rows2 + rows3] == list(range(7)) and end is None
    with pytest.raises(ValueError):
        evidence.preview(df, "id", "v2", cur)
    assert [r["id"] for r in evidence.preview(df, "id", "v", query="ROW 4", errors_only=True)[0]] == [4]


def test_totals_relabel_and_joins(spark):
    parts = spark.createDataFrame([("a", 1), ("a", 2)], "k string, n bigint")
    assert evidence.assert_totals(parts, spark.createDataFrame([("a", 3), ("b", 0)], "k string, t bigint"), ["k"], "n", "t").count() == 2
    with pytest.raises(PySparkException):
        evidence.assert_totals(parts, spark.createDataFrame([("a", 4)], "k string, t bigint"), ["k"], "n", "t").collect()
    r = evidence.relabel(spark.createDataFrame([("raw_R1", 1), ("x", 2)], "stage string, n int"), {"stage": "Stage", "n": "N"}, {"stage": {"raw_R1": "Raw"}})
    assert r.columns == ["Stage", "N"] and {x["Stage"] for x in r.collect()} == {"Raw", "x"}
    rows, lost = evidence.attach_barcodes(spark.createDataFrame([("1",), ("2",), ("3",)], "sequence_id string"), spark.createDataFrame([("1", "AC"), ("2", "AC"), ("2", "GT")], "sequence_id string, barcode string"))
    assert [tuple(x) for x in rows.collect()] == [("1", "AC")] and sorted(x[0] for x in lost.collect()) == ["2", "3"]
    assert evidence.resume(parts, parts.limit(0), ["k"]).count() == 2 and evidence.scoped(parts, parts, ["k"]).count() == 2


def test_exports(spark):
    u = spark.createDataFrame([("g", "", "V", "A", 1, 0, 1, "observed"), ("g", "", "V", "B", 0, 0, 1, "zero_observed"), ("g", "p", "V", "X", 1, 0, 0, "outside_reference")], "group_id string, primer string, segment string, gene string, unique_count int, ambiguous_count int, reference_catalog int, status string")
    e = evidence.exports(u)
    assert {k: v.count() for k, v in e.items()} == {"sample_gene_usage": 1, "primer_gene_usage": 1, "reference_gene_observation": 2, "primer_reference_gene_observation": 0, "unobserved_reference_genes": 1, "primer_unobserved_reference_genes": 0}
    assert json.loads(evidence.summary_json({"a": u, "b": u.limit(0)}))["tables"] == {"a": {"columns": u.columns, "rows": 3}, "b": {"columns": u.columns, "rows": 0}}
    m = spark.createDataFrame([("s", "unique", 50.0, 10, 0), ("s", "multiple", 20.0, 10, 0), ("s", "unmatched", 30.0, 10, 0)], "sample string, match_class string, percent double, denominator bigint, unassessed_count bigint")
    assert tuple(evidence.wide_matching(m, ["sample"]).first()) == ("s", 10, 50.0, 20.0, 30.0, 0)
    assert evidence.umi_sidecar(spark.createDataFrame([("r", "AC"), ("r", "AC"), ("q", None)], "read_id string, umi string")).count() == 1
    assert evidence.candidate_genes(spark.createDataFrame([], "group_id string, segment string, candidates string")).count() == 0
    assert evidence.version_of(spark.createDataFrame([("/a", 1, 2)], "path string, size int, modified int").withColumn("modified", F.col("modified"))) != ""
