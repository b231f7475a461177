import pytest

from vdjloom.operators import packed
from vdjloom.plans.durable import settle

NAMES = ["IgL,w5", "TCRα, tail", "ig_fw;2,alt", "TRB_m5|rev", "KL or LK", 'Mix "long" 3', "TRB/C out 2", "引物_k3", "A_1", "B_2"]


def split(spark, rows, key="id"):
    df = spark.createDataFrame(rows, f"{key} bigint, primers string")
    got = packed.split_packed(df, key, ["primers"], settle).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r[0], r["pos"])):
        assert r["pos"] == len(out.setdefault(r[0], [])) + 1
        out[r[0]].append(r["item"])
    return out


def test_written_in_many_ways(spark):
    import json

    known = [(1000 + i, json.dumps([n])) for i, n in enumerate(NAMES * 20)]
    cases = {
        1: (json.dumps(NAMES[:4]), NAMES[:4]), 2: (json.dumps(json.dumps(NAMES[4:7])), NAMES[4:7]), 3: ("['A_1', 'KL or LK']", ["A_1", "KL or LK"]),
        4: ('"IgL,w5","A_1"', ["IgL,w5", "A_1"]), 5: ("A_1; B_2;;", ["A_1", "B_2"]), 6: ("A_1、引物_k3", ["A_1", "引物_k3"]), 7: ('B_2，"IgL,w5"', ["B_2", "IgL,w5"]),
        8: ('A_1|"TRB_m5|rev"|B_2', ["A_1", "TRB_m5|rev", "B_2"]), 9: ("ig_fw;2,alt", None), 10: ("KL or LK", None), 11: ("A_1,N/A", None), 12: ('["A_1", "", "none", "B_2"]', ["A_1", "B_2"]),
        13: ("A_1, A_1", ["A_1", "A_1"]), 14: ('"Mix ""long"" 3", A_1', ['Mix "long" 3', "A_1"]), 15: ("A_1 or B_2", ["A_1", "B_2"]), 16: ("A_1\tB_2", ["A_1", "B_2"]), 17: ("", None), 18: (None, None),
        19: ('"A_1,B_2"', ["A_1", "B_2"]), 20: ("TRB_m5|rev;A_1", ["TRB_m5|rev", "A_1"]), 21: ('["A_1"]', None), 22: ("A_1 B_2", ["A_1", "B_2"]), 23: ("[]", None), 24: (" \t ", None),
    }
    got = split(spark, known + [(k, s) for k, (s, _) in cases.items()])
    for k, (s, want) in cases.items():
        assert got.get(k) == want, s


def test_redelivered_rows_and_empty_tables(spark):
    known = [(100 + i, "A_1") for i in range(5)] + [(200 + i, "B_2") for i in range(5)]
    assert split(spark, known + [(1, "A_1,B_2"), (1, "A_1,B_2")]) == {1: ["A_1", "B_2"]}
    assert split(spark, []) == {}
    assert split(spark, [(1, None), (2, None)]) == {}


def test_long_text_is_one_value(spark):
    assert split(spark, [(1, "x" * 200_000), (2, "A_1")]) == {}


@pytest.mark.parametrize("text", ['"never closed', '["broken', "'", '""', ",,,", "\\", '{"a": 1}'])
def test_odd_marks_do_not_fail(spark, text):
    assert isinstance(packed.parses(text), dict)
    split(spark, [(1, text), (2, "A_1")])


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "A_1,B_2", "x", "y", 1), (2, "A_1", "x", "y", 1), (3, "B_2", "x", "y", 1)], "id bigint, v_call string, packed string, field_name string, n int")
    got = packed.split_packed(df, "id", ["v_call"], settle).collect()
    assert sorted((r["id"], r["pos"], r["item"]) for r in got) == [(1, 1, "A_1"), (1, 2, "B_2")]


@pytest.mark.parametrize("times", [1, 3, 4, 7])
def test_lists_encoded_many_times(spark, times):
    import json

    text = NAMES[:3]
    for _ in range(times):
        text = json.dumps(text)
    assert split(spark, [(1, text), (2, "A_1")]) == {1: NAMES[:3]}


def test_wrapped_many_times(spark):
    known = [(100 + i, "A_1") for i in range(20)] + [(200 + i, "B_2") for i in range(20)]
    assert split(spark, known + [(1, "[{['`A_1,B_2`']}]"), (2, "'" * 3001)]) == {1: ["A_1", "B_2"]}
