from pyspark.sql import functions as F

from vdjloom.operators import eager


def test_equals_the_joined_rows(spark):
    left = [("hot", i % 5, None if i % 7 == 0 else i) for i in range(300)] + [("b", 1, 2), (None, 3, 4), ("c", None, None)]
    right = [("hot", i) for i in range(40)] + [("b", None), (None, 5), ("z", 1)]
    a, b = spark.createDataFrame(left, "k string, g int, x bigint"), spark.createDataFrame(right, "k string, y bigint")
    got = {r["key_value"]: r for r in eager.eager_join(a, b, F.col("k"), F.col("k"), {"sx": F.col("x")}, {"sy": F.col("y")}).collect()}
    assert set(got) == {"hot", "b", "c", None}
    for k in ("hot", "b", "c"):
        rows = [(x, y) for kk, _, x in left if kk == k for rk, y in right if rk == k]
        assert int(got[k]["joined_rows"]) == len(rows)
        xs, ys = [x for x, _ in rows if x is not None], [y for _, y in rows if y is not None]
        if rows:
            assert (got[k]["joined_sx"] or 0) == sum(xs) and (got[k]["joined_sy"] or 0) == sum(ys)
    assert got[None]["n_left"] == 1 and got[None]["n_right"] == 0


def test_heavy_border_is_exact(spark):
    df = spark.createDataFrame([("a",)] * 2 + [("b",)] * 1 + [(str(i),) for i in range(97)], "k string")
    s = eager.share_of_rows(eager.eager_join(df, df, F.col("k"), F.col("k")), df)
    assert [r["key_value"] for r in eager.heavy(s).collect()] == ["a"]


def test_empty(spark):
    e = spark.createDataFrame([], "k string")
    assert eager.heavy(eager.share_of_rows(eager.eager_join(e, e, F.col("k"), F.col("k")), e)).count() == 0


def test_sums_beyond_doubles_are_exact(spark):
    big = 2**53 + 1
    a = spark.createDataFrame([("a", big)], "k string, x bigint")
    b = spark.createDataFrame([("a", big)] * 3, "k string, y bigint")
    r = eager.eager_join(a, b, F.col("k"), F.col("k"), {"sx": F.col("x")}, {"sy": F.col("y")}).first()
    assert int(r["joined_sx"]) == 3 * big and int(r["joined_sy"]) == 3 * big
