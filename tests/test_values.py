from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vdjloom.functions import values as V
from vdjloom.operators import ranking


def test_copy_count(spark):
    ok = spark.createDataFrame([("3", "3"), ("4", None), ("", "5"), ("2.0", "2")], "copy string, umi_counts string")
    assert [r[0] for r in ok.select(V.copy_count()).collect()] == [3, 4, 5, 2]
    for a, b in (("3", "4"), ("0", None), ("x", "1"), (None, None), ("-1", "-1"), ("1.5", None)):
        with pytest.raises(PySparkException):
            spark.createDataFrame([(a, b)], "copy string, umi_counts string").select(V.copy_count()).collect()


def test_times(spark):
    t = ["2026-03-02T01:12:52+00:00", "2026-03-02 01:12:52", "2026-03-02T03:12:52+02:00", " 2026-03-02T01:12:52Z", "never", "", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in t], "t string").select(V.utc_time("t")).collect()]
    assert got == [datetime(2026, 3, 2, 1, 12, 52)] * 4 + [None] * 3
    d = spark.createDataFrame([(datetime(2026, 3, 1),), (datetime(2026, 1, 1),)], "t timestamp_ntz")
    assert d.filter(V.within_days(F.col("t"), F.lit(datetime(2026, 3, 2)).cast("timestamp_ntz"), 7)).count() == 1


def test_unicode_and_sequences(spark):
    df = spark.createDataFrame([("ＡＢ①",), (None,)], "s string")
    assert [r[0] for r in df.select(V.nfkc("s")).collect()] == ["AB1", None]
    s = spark.createDataFrame([("acgR",), ("ACGT",), ("",), (None,)], "s string")
    assert [tuple(r) for r in s.select(V.valid_sequence("s"), V.valid_sequence("s", "acgt")).collect()] == [(True, False), (True, True), (False, False), (False, False)]


def test_ids_and_counters(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(40)], "a int, b int")
    got = [r["new_id"] for r in ranking.sequential_ids(df, [F.asc("a"), F.asc("b")], 5).orderBy("a", "b").collect()]
    assert got == list(range(5, 45))
    old, new = spark.createDataFrame([("x", 1), ("y", 2)], "k string, n bigint"), spark.createDataFrame([("x", 3), ("z", 1)], "k string, n bigint")
    assert {r["k"]: r["n"] for r in ranking.add_counts(old, new, ["k"]).collect()} == {"x": 4, "y": 2, "z": 1}
