import os

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from vdjloom.llm import reading as R

DATA = "/root/testdata/sf0.01"


def test_main_text_only():
    t = "| tube | n |\n|---|---|\n| B9 | 886 |\n- The cup is red\n1. We saw it. It was cold.\nACGTACGTACGT\n[16:43] stage=7 rows=18517\nTRG\t1975\t80.43\n"
    assert R.sentences(t) == ["The cup is red", "We saw it.", "It was cold."]
    assert R.sentences(None) == R.sentences(" \n ") == R.sentences("|---|") == []
    assert R.sentences("管子是红的。你看到标签了吗？") == ["管子是红的。", "你看到标签了吗？"]


def test_chinese():
    assert R.is_chinese("今天引物清单得到79417条记录") and not R.is_chinese("A long english text with 引物") and not R.is_chinese(None) and not R.is_chinese("123")


@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 5)), min_size=1, max_size=30))
def test_isotonic_is_monotone_and_keeps_the_mean(points):
    x, y = np.array([p[0] for p in points], float), np.array([p[1] for p in points], float)
    bx, by = R.isotonic(x, y)
    assert (np.diff(by) >= 0).all() and (np.diff(bx) >= 0).all()
    assert y.min() - 1e-9 <= by.min() and by.max() <= y.max() + 1e-9


def test_isotonic_pools():
    _, y = R.isotonic(np.array([1.0, 2, 3, 4]), np.array([1.0, 3, 2, 4]))
    assert y.tolist() == [1.0, 2.5, 4.0]


def test_ranker_orders_pairs():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 6))
    grade = np.round(x[:, 0] * 2 + x[:, 1])
    w, n = R.learn_ranker(x, grade)
    assert n > 1000
    i, j = rng.integers(0, 200, (2, 4000))
    k = grade[i] > grade[j]
    assert ((x @ w)[i][k] > (x @ w)[j][k]).mean() > 0.95


def test_weighted_median():
    assert R.weighted_median([1.0, 9.0], [1.0, 8.0]) == 9.0
    assert R.weighted_median([3.0, 1.0], [2.0, 2.0]) == 2.0
    assert R.weighted_median([3.0], [0]) == 3.0


@given(st.lists(st.text("ab ,.;:é_1/引物。，\n-'", max_size=40), max_size=4))
def test_scorer_is_the_features_times_the_weights(parts):
    """The quick way over words and the features the ranker was trained on give one score."""
    text = "\n".join(parts)
    model = R.ReadingModel(np.random.default_rng(2).normal(size=R.SYNTAX + R.VOCABULARY), [], 0, 0)
    out, size = [], []
    for f in filter(None, map(R.sentence_features, R._prose(text))):
        out.append(float(model.weights[: R.SYNTAX] @ np.array(f[0])) + (float(model.weights[R.SYNTAX :][f[1]].mean()) if f[1] else 0.0))
        size.append(min(len(f[1]), R.FULL_SENTENCE))
    got = model.score(text)
    assert got is None if not out else abs(got - R.weighted_median(out, size)) < 1e-9


def test_names_are_no_vocabulary():
    words = R._WORD.findall(R._CODED.sub(" ", "see run_3/a.csv now, b=1 and c2 there x"))
    assert words == ["see", "now", "and", "there", "x"]
    assert R._CODED.sub(" ", "x" * 300_000) == "x" * 300_000


def _frames(spark):
    docs, marks = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/reading_marks.parquet")
    return docs, marks


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_held_out_accuracy(spark):
    docs, marks = _frames(spark)
    train, test = marks.filter("doc_id % 3 <> 0"), marks.filter("doc_id % 3 = 0")
    model = R.train(docs, train)
    got = R.reading_levels(docs, model).join(test.groupBy("doc_id").agg({"reading_level": "avg"}), "doc_id").collect()
    hit = [(r["reading_level"] >= 4) == (r["avg(reading_level)"] >= 3.75) for r in got]
    near = [abs(r["reading_level"] - r["avg(reading_level)"]) <= 1 for r in got]
    assert len(hit) > 40 and sum(hit) / len(hit) > 0.9 and sum(near) / len(near) > 0.9


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_five_folds(spark):
    """What the README says of documents that the model has not seen."""
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "reading_marks"))
    got = R.train(docs, marks).held_out
    assert got["demanding_as_marked"][1] > 1000 and got["demanding_as_marked"][0] > 0.95
    assert got["demanding_as_agreed"][0] > 0.98 and got["within_one_level"][0] > 0.97


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_odd_texts_and_no_marks(spark):
    docs, marks = _frames(spark)
    odd = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "|a|b|", 1), (4, "x" * 300_000, 1), (5, "We saw it. " * 20_000, 1), (6, "We saw it.", 1), (6, "We saw it.", 1)], "doc_id bigint, text string, score int")
    model = R.train(docs, marks)
    got = {r["doc_id"]: r for r in R.reading_levels(odd, model).collect()}
    assert [got[i]["reading_level"] for i in (1, 2, 3)] == [None] * 3
    assert got[5]["reading_level"] == got[6]["reading_level"] and got[5]["n_text"] == 220_000
    empty = R.train(docs, marks.filter("false"))
    assert {r["reading_level"] for r in R.reading_levels(odd.filter("doc_id = 6"), empty).collect()} == {1}
    assert R.reading_levels(odd.filter("false"), model).count() == 0
    assert R.demanding(R.reading_levels(odd, model)).count() >= 0
