from pyspark.sql import functions as F

from vdjloom.functions import calls as C
from vdjloom.functions import headers as H
from vdjloom.functions.text import WHITE_SPACE, pct, reference_key, strip, value_key


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()[0]


def test_strip_knows_all_white_space(spark):
    assert set(WHITE_SPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}
    assert one(spark, " 　a b\t\n", strip("x")) == "a b"
    assert one(spark, None, strip("x")) is None


def test_reference_and_value_keys(spark):
    for word in ("", " ", "*", "-", "na", "N/A", "None", "null", "NO_HIT", "unmapped", "not_found", None):
        assert one(spark, word, reference_key("x")) is None
    assert one(spark, " AbC\t", reference_key("x")) == "abc"
    assert one(spark, 7, reference_key("x"), "bigint") == "7"
    assert one(spark, " ab ", value_key("x")) == "AB"
    assert one(spark, "  ", value_key("x")) is None


def test_calls(spark):
    assert one(spark, "IGHV1-2*01,IGHV1-2*02", C.calls("x")) == ["IGHV1-2"]
    assert one(spark, " B*1; A*2 ,N/A,*", C.calls("x")) == ["A", "B"]
    assert one(spark, None, C.calls("x")) == []
    assert one(spark, "IGHG1*01,IGHG2*01", C.unique_gene("x")) is None
    assert one(spark, "b*1|A*2,NA", C.normal_gene("x")) == "A|B"
    assert one(spark, "a c-g.T", C.normal_nt("x")) == "ACGT"


def test_isotype(spark):
    assert tuple(one(spark, "IGHG1*01,IGHG2*01", C.isotype("x"))) == ("IgG", "", "classified")
    assert tuple(one(spark, "IGHM,IGHD", C.isotype("x"))) == ("", "", "ambiguous")
    assert tuple(one(spark, "N/A", C.isotype("x"))) == ("", "", "unannotated")
    assert tuple(one(spark, "IGHG1", C.isotype("x"))) == ("IgG", "IgG1", "classified")
    assert tuple(one(spark, "TRBC1", C.isotype("x"))) == ("", "", "unclassified")


def test_numbers(spark):
    for text, want in (("3", 3), ("3.0", 3), ("3.5", None), ("-1", None), ("x", None), ("", None), (None, None)):
        assert one(spark, text, C.count("x")) == want
    for text, want in (("1.5", 1.5), ("nan", None), ("inf", None), ("x", None)):
        assert one(spark, text, C.number("x")) == want
    assert spark.range(1).select(pct(F.lit(1), F.lit(0))).first()[0] is None


def test_natural_order(spark):
    got = [r[0] for r in spark.createDataFrame([("IGHV10",), ("IGHV2-1",), ("IGHV2",)], "g string").orderBy(C.natural_order("g")).collect()]
    assert got == ["IGHV2", "IGHV2-1", "IGHV10"]
    assert one(spark, "IGHJ4-1*02", C.gene_family("x", F.lit("J"))) == "IGHJ4"
    assert one(spark, "IGHJ4*02", C.gene_family("x", F.lit("J"))) == "IGHJ"
    assert one(spark, "odd*1", C.gene_family("x", F.lit("V"))) == "ODD"


def test_headers(spark):
    assert one(spark, "A:1:F:1:0012:0034:0056:7#ACGT/1 x", H.canonical_header("x")) == "A:1:F:1:12:34:56"
    assert one(spark, "@S:L04:R001C001:0000:0293/2", H.canonical_header("x", True)) == "S:4:1001:0:293"
    assert one(spark, "#UMI:acgt", H.umi("x")) == "ACGT"
    assert one(spark, "id#UMI:ACGN rest", H.header_umi("x")) == "ACGN"
    assert one(spark, "ACXT", H.umi("x")) is None
    assert one(spark, "BC_007", H.barcode_name("x")) == "7"
    assert one(spark, "ACGN", H.reverse_complement("x")) == "NCGT"


def test_read_structure(spark):
    r1 = "A" * 16 + "C" * 10 + "TTTCTT" + "GGG"
    assert tuple(one(spark, r1, H.tso_parts("x", "TTTCTT"))) == (27, "A" * 16, "C" * 10, "GGG")
    assert tuple(one(spark, "ACGT", H.tso_parts("x", "TTTCTT"))) == (0, None, None, None)
    assert tuple(one(spark, "A" * 10 + "ACGTACGT" + "GG", H.bulk_parts("x", F.lit("ACGTACGT")))) == ("A" * 10, "match", "GG")
    assert one(spark, "ACG", H.bulk_parts("x", F.lit("ACGTACGT")))["state"] == "short"
    q = one(spark, "I!", H.quality("x"))
    assert q["mean_quality"] == 20.0 and abs(q["expected_errors"] - 1.0001) < 1e-9
    assert one(spark, "", H.quality("x"))["mean_quality"] is None
    assert one(spark, "NNNACGT", H.barcode_prefix("x", "ACGT")) is True
