import math
from collections import Counter
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vdjloom.operators import bcell, cells, clones, diversity, filters, lineage, matching, primers, ranking, stages, umi, usage


# --- diversity -------------------------------------------------------------------------------


def metrics(spark, weights, **kw):
    df = spark.createDataFrame([("s", w, f"C{i}") for i, w in enumerate(weights)], "s string, umi_counts bigint, cdr3_aa string")
    return diversity.diversity(df, ["s"], **kw).first()


def test_diversity_fixture(spark):
    m = metrics(spark, [5, 3, 1, 1])
    assert m["D50"] == 25.0 and abs(m["Shannon_index"] - 1.1682824502) < 1e-9 and abs(m["Pielou_evenness"] - 0.8427376486) < 1e-9
    assert abs(m["Gini_index"] - 0.1) < 1e-9 and abs(m["Simpson_index"] - 0.64) < 1e-9 and abs(m["Simpson_evenness"] - 0.6944444444) < 1e-9
    assert abs(metrics(spark, [5, 3, 1, 1], base=2)["Shannon_index"] - 1.6854752972) < 1e-9
    m = metrics(spark, [4, 4, 4, 4])
    assert (m["D50"], m["Gini_index"], m["Simpson_index"], m["Simpson_evenness"], m["Pielou_evenness"]) == (50.0, 0.0, 0.75, 1.0, 1.0)
    m = metrics(spark, [7])
    assert (m["D50"], m["Shannon_index"], m["Pielou_evenness"], m["Gini_index"], m["Simpson_evenness"]) == (0.0, 0.0, None, 0.0, 1.0)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 60), min_size=1, max_size=40))
def test_diversity_against_rows(spark, w):
    m = metrics(spark, w)
    t, run, half = sum(w), 0, 0
    for x in sorted(w, reverse=True):
        run += x
        half += 2 * run <= t
    assert abs(m["D50"] - 100 * half / len(w)) < 1e-9
    assert abs(m["Shannon_index"] + sum(x / t * math.log(x / t) for x in w)) < 1e-9
    up = area = 0
    for x in sorted(w):
        up += x
        area += up / t
    assert abs(m["Gini_index"] - max(0, 1 - 2 * area / len(w))) < 1e-9


def test_running_over_many_partitions_with_other_columns(spark):
    """A million rows from many splits, with a column that takes no part, and no exchange used twice."""
    from pyspark.sql import Window

    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        g = F.when(F.col("id") % 3 == 0, "h").when(F.col("id") % 97 != 1, "g")
        df = spark.range(0, 1_000_000, 1, 16).select(g.alias("g"), (F.hash("id") % 5000).cast("bigint").alias("w"), F.col("id").alias("i"), F.concat(F.lit("text"), "id").alias("extra"))
        order = [F.desc("w"), F.asc("i")]
        w = Window.partitionBy("g").orderBy(*order)
        r = ranking.running(df, ["g"], order, "w", whole="all").withColumns({
            "r": F.row_number().over(w), "s": F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, 0)), "a": F.sum("w").over(Window.partitionBy("g")),
        })
        assert r.count() == 1_000_000
        assert r.filter("rank <> r or running <> s or all <> a or extra <> concat('text', i)").count() == 0
    finally:
        spark.conf.set("spark.sql.exchange.reuse", "true")


def test_running_over_large_groups(spark):
    rows = [("g" if i % 3 else "h", i % 50, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, w bigint, i bigint")
    got = ranking.running(df, ["g"], [F.desc("w"), F.asc("i")], "w").collect()
    for g in ("g", "h"):
        run = 0
        mine = {r["i"]: r for r in got if r["g"] == g}
        for k, (_, w, i) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])), 1):
            run += w
            assert (mine[i]["rank"], mine[i]["running"]) == (k, run)


# --- filters ---------------------------------------------------------------------------------


def test_airr_filter_counts_before_distinct(spark):
    row = ("s", "IGH", "T", "V1", "J1", 200.0, 99.0, "AAA")
    df = spark.createDataFrame([("1", *row), ("2", *row), ("3", *row[:4], "J2", *row[5:])], "sequence_id string, s string, locus string, productive string, v_call string, j_call string, v_score double, v_identity double, sequence string")
    got = filters.airr_filter(df, ["s"]).collect()
    assert len(got) == 2 and {r["umi_counts"] for r in got} == {3}


def test_tcr_rule(spark):
    rows = [("s", "TRB", "T", "V", "J", 200.0, 99.0 + i / 10, f"A{i}") for i in range(10)]
    df = spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], "sequence_id string, s string, locus string, productive string, v_call string, j_call string, v_score double, v_identity double, sequence string")
    assert {r["v_identity"] for r in filters.airr_filter(df, ["s"]).collect()} == {99.7, 99.8, 99.9}


def test_mapping_reasons_in_order(spark):
    rows = [("", "T", "IGH"), ("V", "F", "IGH"), ("V", "T", "XX"), ("V", "T", "IGK"), ("V", "true", "igh"), ("V", None, "IGH"), (None, "T", "IGH"), ("V", "T", None)]
    df = spark.createDataFrame(rows, "v_call string, productive string, locus string")
    got = [r[0] for r in df.select(filters.mapping_reason(F.lit("IGH"))).collect()]
    assert got == ["no_v_call", "nonproductive_or_unknown", "unknown_locus", "different_locus", "retained", "nonproductive_or_unknown", "no_v_call", "unknown_locus"]


# --- B cells ---------------------------------------------------------------------------------


def test_class_switching_fixture(spark):
    rows = [("s", "IGH", "X", "IGHM", 4), ("s", "IGH", "X", "IGHG1", 1), ("s", "IGH", "X", "IGHG1", 1), ("s", "IGH", "Y", "IGHA", 4)]
    df = spark.createDataFrame(rows, "s string, locus string, cdr3_aa string, c_call string, umi_counts bigint")
    r = bcell.class_switching(df, ["s"]).first()
    assert abs(r["unswitched"] - 0.4) < 1e-12 and abs(r["switched"] - 0.6) < 1e-12
    p = bcell.switch_pairs(df, ["s"]).collect()
    assert [(x["csr_name"], x["ratio"]) for x in p] == [("IGHG1-IGHM_CSR_ratio", 0.6)]


def brute_score(a, b):
    """The best score of a global affine alignment, by full recursion over a table of Python numbers."""
    low = float("-inf")
    n, m = len(a), len(b)
    M = [[[low] * 3 for _ in range(m + 1)] for _ in range(n + 1)]
    M[0][0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            if i and j:
                M[i][j][0] = max(M[i - 1][j - 1]) + (2 if a[i - 1] == b[j - 1] else -1)
            if j:
                M[i][j][1] = max(M[i][j - 1][0] - 2, M[i][j - 1][2] - 2, M[i][j - 1][1] - 0.5)
            if i:
                M[i][j][2] = max(M[i - 1][j][0] - 2, M[i - 1][j][1] - 2, M[i - 1][j][2] - 0.5)
    return max(M[n][m])


@settings(max_examples=60, deadline=None)
@given(st.text("ACG-", max_size=9), st.text("ACG-", max_size=9))
def test_alignment_is_optimal(a, b):
    import numpy as np

    from vdjloom.operators.bcell import align

    mm, ins, dele, total, ratio = align(a, b)
    assert total == mm + ins + dele and 0 <= ratio <= 1
    assert abs(brute_score(a, a) - 2 * len(a)) < 1e-9
    if "-" not in a + b:
        both = len(a) - ins
        assert both == len(b) - dele
        gaps_least = (ins > 0) + (dele > 0)
        # the path's own score can't beat the best one, and reaches it if its gaps are runs
        best = brute_score(a, b)
        score = 2 * (both - mm) - mm - 0.5 * (ins + dele) - 1.5 * gaps_least
        assert score >= best - 1e-9
    assert np.isfinite(ratio)


def plain_alignment(a, b):
    """U02 cell by cell: three tables of Python numbers, doubled scores, the same preferences on the way back."""
    low, n, m = -(10**9), len(a), len(b)
    S = [[[low] * (m + 1) for _ in range(n + 1)] for _ in range(3)]
    S[0][0][0] = 0
    for i in range(n + 1):
        for j in range(m + 1):
            if i and j:
                S[0][i][j] = max(S[k][i - 1][j - 1] for k in range(3)) + (4 if a[i - 1] == b[j - 1] else -2)
            if i:
                S[2][i][j] = max(S[0][i - 1][j] - 4, S[1][i - 1][j] - 4, S[2][i - 1][j] - 1)
            if j:
                S[1][i][j] = max(S[0][i][j - 1] - 4, S[2][i][j - 1] - 4, S[1][i][j - 1] - 1)
    i, j, columns = n, m, []
    state = max(range(3), key=lambda k: (S[k][i][j], -k))
    while i or j:
        columns.append((a[i - 1] if state != 1 else "-", b[j - 1] if state != 2 else "-"))
        here = S[state][i][j]
        i, j = i - (state != 1), j - (state != 2)
        if state == 0:
            state = max(range(3), key=lambda k: (S[k][i][j], -k))
        elif S[0][i][j] - 4 == here:
            state = 0
        elif S[3 - state][i][j] - 4 == here:
            state = 3 - state
    dele, ins = sum(x == "-" != y for x, y in columns), sum(y == "-" != x for x, y in columns)
    both = [(x, y) for x, y in columns if x != "-" and y != "-"]
    mm = sum(x != y for x, y in both)
    return mm, ins, dele, mm + ins + dele, (mm + ins + dele) / (len(both) + ins + dele) if both or ins + dele else 0.0


@pytest.mark.parametrize("cells", [24_000_000, 1500])
def test_alignments_together_are_those_cell_by_cell(monkeypatch, cells):
    """Pairs of one length in their bands, others in full, all in batches, and with rows filled twice where memory is short."""
    import random

    monkeypatch.setattr(bcell, "BATCH_CELLS", cells)
    rng, pairs = random.Random(5), []
    for _ in range(500):
        a = [rng.choice("ACGT-N") for _ in range(rng.randrange(40))]
        b = a[:]
        for _ in range(rng.randrange(8)):
            if b:
                b[rng.randrange(len(b))] = rng.choice("ACGT-")
        if rng.random() < 0.4:
            for _ in range(rng.randrange(3)):
                b.insert(rng.randrange(len(b) + 1), rng.choice("ACGT"))
            del b[: rng.randrange(3)]
        pairs.append(("".join(a), "".join(b if rng.random() < 0.9 else rng.choices("AC", k=len(a)))))
    assert [x for x in zip(pairs, bcell.align_all(pairs)) if x[1] != plain_alignment(*x[0])] == []


def test_long_pair_in_bounded_memory():
    import random
    import tracemalloc

    rng = random.Random(6)
    a = "".join(rng.choice("ACGT") for _ in range(5000))
    b = a[:2000] + a[2003:4000] + "T" + a[4000:]
    tracemalloc.start()
    got = bcell.align(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[:3] == (0, 3, 1) or got[3] == 4
    assert peak < 120e6  # three whole tables would be 300 MB


def test_alignment_cases():
    assert bcell.align("ACGT", "ACGT") == (0, 0, 0, 0, 0.0)
    assert bcell.align("ACGT", "ACCT")[:3] == (1, 0, 0)
    assert bcell.align("ACGTACGT", "ACGTGT")[1] == 2
    assert bcell.align("", "") == (0, 0, 0, 0, 0.0)
    assert bcell.align("", "AC") == (0, 0, 2, 2, 1.0)


def test_shm_metrics(spark):
    rows = [("s", "IGH", "IGHM", "ACGTAC", "ACGTAC", 1, 4, 3), ("s", "IGH", "IGHG1", "ACGTAC", "ACCTAC", 1, 4, 1), ("s", "TRB", None, "A", "A", 1, 1, 5)]
    df = bcell.with_shm(spark.createDataFrame(rows, "s string, locus string, c_call string, sequence_alignment string, germline_alignment string, v_alignment_start int, v_alignment_end int, umi_counts bigint"))
    r = bcell.shm_shares(df, ["s"]).first()
    assert (r["v_mutated"], r["v_unmutated"], r["v_naive_mutated"], r["v_naive_unmutated"]) == (0.25, 0.75, 0.0, 1.0)
    loc = {x["locus"]: x for x in bcell.shm_by_locus(df, ["s"]).collect()}
    assert loc["IGH"]["v_shm"] == 0.25
    iso = {x["gene"]: x for x in bcell.shm_by_isotype(df, ["s"]).collect()}
    assert iso["IGHG1"]["mean_shm_percent"] == 25.0 and iso["IGHM"]["isotype"] == "IgD/M"


# --- UMIs and cells --------------------------------------------------------------------------


def reps(spark, rows, **kw):
    df = spark.createDataFrame([("u", s, q, e, f"h{i}", i) for i, (s, q, e) in enumerate(rows)], "umi string, sequence string, mean_quality double, expected_errors double, header string, ordinal bigint")
    return umi.representatives(umi.sequence_counts(df, ["umi"]), ["umi"], **kw).first()


def test_representative_fixture(spark):
    r = reps(spark, [("ACGT", 30.0, 0.5)] * 2 + [("ACGA", 30.0, 0.3)] * 2 + [("ACGN", 30.0, 0.1)])
    assert (r["sequence"], r["ambiguity"], r["selection_method"], r["percent"]) == ("ACGA", "RESOLVED_BY_QUALITY", "COUNT_THEN_QUALITY", 40.0)
    r = reps(spark, [("ACGT", None, None)] * 2 + [("ACGA", None, None)] * 2)
    assert (r["sequence"], r["ambiguity"], r["selection_method"]) == ("ACGA", "TIED_NO_QUALITY", "COUNT_ONLY_NO_QUALITY")
    r = reps(spark, [("ACGT", 30.0, 0.5), ("ACGA", 30.0, 0.5)])
    assert (r["sequence"], r["ambiguity"]) == ("ACGA", "TIED_AFTER_QUALITY")
    assert reps(spark, [("ACGT", 30.0, 0.5)], droplet=True)["selection_method"] == "COUNT"


def test_alias_lookup(spark):
    state = spark.createDataFrame([("s", "A:1:F:1:0012:3:4:9#x", "ACGT"), ("s", "r2", "AAAA"), ("s", "r2", "CCCC")], "sample string, id string, umi string")
    q = spark.createDataFrame([("s", "A:1:F:1:12:3:4"), ("s", "r2"), ("s", "r3")], "sample string, id string")
    got = {r["id"]: (r["umi"], r["status"]) for r in umi.lookup_umi(q, "sample", "id", umi.alias_index(state, "sample", "id", "umi")).collect()}
    assert got == {"A:1:F:1:12:3:4": ("ACGT", "matched"), "r2": (None, "conflict"), "r3": (None, "missing")}


def test_secondary_support(spark):
    pairs = [(42, 40, True), (42, 10, True), (42, 2, False), (9, 1, True), (10, 1, False), (5, 0, False)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint, want boolean")
    assert all(r["x"] == r["want"] for r in df.withColumn("x", cells.supported(F.col("a"), F.col("b"))).collect())


# --- primers ---------------------------------------------------------------------------------


def test_primer_fixture(spark):
    p = [("p1", "ACR", "g")]
    df = spark.createDataFrame([(1, "ACGTT"), (2, "ACNTT"), (3, "TACG"), (4, ""), (5, None), (6, "ACA")], "id bigint, seq string")
    got = {r["id"]: r for r in primers.categorise(df, "seq", p).collect()}
    assert [got[i]["match_class"] for i in range(1, 7)] == ["unique", "unmatched", "unmatched", "sequence_unavailable", "sequence_unavailable", "unique"]
    assert got[1]["trim_state"] == "trimmed_unique" and got[1]["trim_length"] == 3 and got[6]["trim_state"] == "primer_only_untrimmed"
    two = primers.categorise(df, "seq", [*p, ("p2", "ACGT", "g")]).filter("id = 1").first()
    assert (two["match_class"], two["trim_state"], two["names"]) == ("multiple", "ambiguous_length_untrimmed", ["p1", "p2"])
    assert primers.categorise(df, "seq", []).filter("id = 1").first()["match_class"] == "not_configured"


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ACGTRYN", min_size=1, max_size=9), min_size=1, max_size=4, unique=True), st.lists(st.text("ACGTN", max_size=10), min_size=1, max_size=8))
def test_primers_against_patterns(spark, seqs, reads):
    import re

    p = [(f"p{i}", s, "g") for i, s in enumerate(seqs)]
    df = spark.createDataFrame(list(enumerate(reads)), "id bigint, seq string")
    got = {r["id"]: r["names"] for r in primers.match(df, "id", "seq", p).collect()}
    for i, r in enumerate(reads):
        assert got.get(i, []) == sorted(n for n, s, _ in p if re.match(primers.pattern(s), r))


def test_primer_tables_are_bounded_and_move_no_read(spark):
    many = [(f"p{i}", "N" * 12, "g") for i in range(300)]
    df = spark.createDataFrame([(1, "ACGTACGTACGTA", "x"), (1, "ACGTACGTACGTA", "x"), (2, None, "y")], "id bigint, seq string, names2 string")
    got = primers.with_match(df, "seq", many)
    assert sorted((r["id"], len(r["names"])) for r in got.collect()) == [(1, 300), (1, 300), (2, 0)]
    assert sum(len(primers.prefixes(s, primers.MAX_TABLE // len(many))[1]) for _, s, _ in many) <= primers.MAX_TABLE
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Aggregate" not in plan
    with pytest.raises(ValueError):
        primers.with_match(df, "seq", [("p", "A", "g")] * (primers.MAX_TABLE + 1))


def test_degenerate_primers_keep_a_prefix(spark):
    n, concrete = primers.prefixes("NNNNNNNNNN")
    assert n == 6 and len(concrete) == 4096
    df = spark.createDataFrame([(1, "ACGTACGTAC"), (2, "ACGTACGTAN"), (3, "ACGT")], "id bigint, seq string")
    assert [r["id"] for r in primers.match(df, "id", "seq", [("d", "N" * 10, "g")]).collect()] == [1]


def test_catalogue_and_settings(spark):
    with pytest.raises(ValueError):
        primers.catalogue(spark, [("s", "IGH", "g", "p", "AC"), ("s", "IGK", "g", "p", "AG")])
    with pytest.raises(ValueError):
        primers.catalogue(spark, [("s", "IGH", "g", "p", "AX")])
    with pytest.raises(ValueError):
        primers.settings(101)
    assert primers.strip_structure(primers.ADAPTER + "N" * 10 + "ACGTACGT" + "GGA") == "GGA"


def test_catalogue_of_a_sheet(spark):
    o = lambda x: primers.ADAPTER + "N" * 10 + "ACGTACGT" + x
    sheet = [("g1", "a", o("NGA")), ("g1", "b", o("CC")), ("g2", "c", o("TT")), ("", "", "")]
    build = lambda *a, **k: [tuple(r) for r in primers.build_catalogue(spark, *a, **k).collect()]
    got = build(sheet, [("S-1", None, "g1; g2"), ("other", None, "nowhere")], ["s1"], {"s1": "S-1"}, separator=";")
    assert got == [("s1", None, "g1", "a", "NGA"), ("s1", None, "g1", "b", "CC"), ("s1", None, "g2", "c", "TT")]
    assert build(sheet, [("s", None, "c")], ["s"], by_name=True) == [("s", None, "g2", "c", "TT")]
    by_chain = [("s", "IGH", "g2"), ("s", "TRA", "g1")]
    assert build(sheet, by_chain, ["s"], sample_chains={"s": ["IGH"]})[0] == ("s", "IGH", "g2", "c", "TT")
    for wrong in (
        lambda: build(sheet, [("s", None, "g1")], ["s", "t"]), lambda: build(sheet, [("s", None, "c")], ["s"]), lambda: build(sheet, [("", None, "g1")], ["s"]),
        lambda: build(sheet, by_chain, ["s"], sample_chains={"s": ["IGK"]}), lambda: build([*sheet, ("g3", "a", o("GG"))], [("s", None, "g1")], ["s"]),
        lambda: build([("g1", "a", "ACGT")], [("s", None, "g1")], ["s"]), lambda: build([("g1", "a", "")], [("s", None, "g1")], ["s"]),
        lambda: primers.strip_structure(primers.ADAPTER + "ACGTACGTACACGTACGTGGA"),
    ):
        with pytest.raises(ValueError):
            wrong()


# --- usage, lineage, stages ------------------------------------------------------------------


def test_copy_allocation_fixture(spark):
    r = spark.createDataFrame([(i, g, 1, w, "k") for i, (g, w) in enumerate([("a", 5), ("b", 5), ("c", 5)])] + [(9, "d", 1, 2, "k"), (10, "d", 1, 3, "k")], "id bigint, group_id string, sample_record int, weight bigint, identity_key string")
    lin = spark.createDataFrame([("a", "k", "p1", 3), ("a", "k", "p2", 2), ("b", "k", "p1", 3), ("b", "k", "", 2), ("c", "k", "p1", 3), ("d", "k", "p1", 2)], "group_id string, identity_key string, primer string, n bigint")
    alloc, totals = usage.allocate_copies(r, lin)
    assert sorted((x["group_id"], x["primer"], x["copies"]) for x in alloc.collect()) == [("a", "p1", 3), ("a", "p2", 2), ("b", "p1", 3)]
    assert {x["group_id"]: (x["allocated"], x["unresolved"]) for x in totals.collect()} == {"a": (5, 0), "b": (3, 2), "c": (0, 5), "d": (0, 5)}


def test_gene_usage_status(spark):
    counts = spark.createDataFrame([("g", "", "V", "A", "unique", 3), ("g", "", "V", "B", "ambiguous", 2), ("g", "", "V", "X", "unique", 1), ("g", "", "V", "", "unannotated", 4)], "group_id string, primer string, segment string, gene string, assignment string, count bigint")
    ref = spark.createDataFrame([("g", "V", "A"), ("g", "V", "B"), ("g", "V", "Z")], "group_id string, segment string, gene string")
    got = {r["gene"]: r for r in usage.gene_usage(counts, ref, spark.createDataFrame([("g", "")], "group_id string, primer string")).collect()}
    assert {k: v["status"] for k, v in got.items()} == {"A": "observed", "B": "ambiguous_only", "X": "outside_reference", "Z": "zero_observed"}
    assert got["A"]["percent"] == 75.0 and got["Z"]["percent"] == 0.0


def test_matching_totals_conflict(spark):
    rows = [("s", "f", 1, "IGH", "all", "unique", "queries"), ("s", "f", 1, "TRA", "all", "unmatched", "queries"), ("s", "f", 2, "IGH", "all", "unique", "queries"), ("s", "f", 2, "TRA", "x", "unique", "queries")]
    df = spark.createDataFrame(rows, "sample_key string, matching_source string, matching_ordinal bigint, chain string, scope string, sample_match_class string, matching_unit string")
    got = sorted((r["match_class"], r["scope"], r["chains"], r["count"]) for r in lineage.matching_totals(df).collect())
    assert got == [("conflicting_assessment", "all", "IGH,TRA", 1), ("unique", "mixed_annotation_evidence", "IGH,TRA", 1)]


def test_unique_join_keeps_rows(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "c")], "id bigint, k string")
    right = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("b", 2, "z"), (None, 1, "n")], "k string, o bigint, v string")
    got = {r["id"]: (r["n_matches"], r["v"]) for r in lineage.unique_join(left, right, ["k"], ["k"], "o", ["v"]).collect()}
    assert got == {1: (1, "x"), 2: (2, None), 3: (0, None), 4: (0, None)}


def test_stage_totals_need_every_pair(spark):
    rows = spark.createDataFrame([("s", "p1", "merged", "", 5), ("s", "p2", "merged", "", 6), ("s", "p2", "merged", "", 6), ("t", "p1", "merged", "", 5)], "sample string, pair string, stage string, chain string, count bigint")
    pairs = spark.createDataFrame([("s", "p1"), ("s", "p2"), ("t", "p1"), ("t", "p2")], "sample string, pair string")
    assert {r["sample"]: r["count"] for r in stages.stage_totals(rows, pairs).collect()} == {"s": 11, "t": None}
    m = stages.mapping_volumes(spark.createDataFrame([("s", "merged", "", 10), ("s", "mapping_input", "IGH", 8), ("s", "mapping_output", "IGH", 6)], "sample string, stage string, chain string, count bigint"))
    assert sorted((r["stage"], r["reduction"], r["retention_percent"]) for r in m.collect()) == [("mapping_input", 2, 80.0), ("mapping_output", None, None)]


def test_metadata_matching(spark):
    files = spark.createDataFrame([("/data/20240829/x_S1_R1",), ("/data/20240829_A/x_S1_R1",), ("/data/20240829/y_D14_R1",), ("/data/20240829/z",)], "path string")
    rec = spark.createDataFrame([(1, "data/20240829", "S1", "D14"), (2, "20240829", "S10", "D14"), (3, "20240830", "S1", "")], "record_id bigint, note string, sample_id string, dual_index string")
    got = sorted((r["path"], r["record_id"] or 0, r["match_method"]) for r in matching.match_files(files, rec).collect())
    assert got == [("/data/20240829/x_S1_R1", 1, "sample_id"), ("/data/20240829/y_D14_R1", 1, "dual_index_multi"), ("/data/20240829/y_D14_R1", 2, "dual_index_multi"), ("/data/20240829/z", 0, "error"), ("/data/20240829_A/x_S1_R1", 0, "error")]


def test_scenario_copies_and_usage(spark):
    reads = spark.createDataFrame([(1, "g", "r1", "TTA"), (2, "g", "r2", "TTA"), (3, "g", "r3", "TTC"), (4, "g", "r4", "GGG"), (5, "h", "r5", "TTA")], "k bigint, group_id string, read string, seq string")
    sus = spark.createDataFrame([("g", "B", "suspected"), ("h", "B", "below_threshold")], "group_id string, tested_group string, status string")
    m = primers.scenarios(reads, "seq", [("a", "GG", "A"), ("b1", "TTA", "B"), ("b2", "TTC", "B")], sus, ["group_id"])
    final = spark.createDataFrame([("g", "r1", "x"), ("g", "r2", "x"), ("g", "r3", "x"), ("g", "r4", "y"), ("g", "r9", "y"), ("h", "r5", "x")], "group_id string, read string, identity_key string")
    line = usage.scenario_lineage(m, final, ["read"])
    assert sorted((r["identity_key"], r["primer"], r["n"]) for r in line.collect()) == [("x", "b1", 2), ("x", "b2", 1), ("y", "", 2)]
    rec = spark.createDataFrame(
        [(1, "g", "", 1, 3, 1, "cdr3_aa", "CAR", 1, "x"), (2, "g", "", 1, 2, 1, "cdr3_aa", "CAS", 1, "y"), (3, "h", "", 1, 1, 1, "cdr3_aa", "CAR", 1, "x")],
        "id bigint, group_id string, primer string, sample_record int, weight bigint, eligible int, aa_field string, aa_value string, aa_valid int, identity_key string",
    )
    calls = spark.createDataFrame([(1, "V", "V1", "unique"), (2, "V", "V2", "unique"), (3, "V", "V1", "unique")], "record_id bigint, segment string, gene string, assignment string")
    r, c, totals = usage.scenario_records(rec, calls, line, m.select("scenario_id", "group_id"))
    sid = m.first()["scenario_id"]
    assert [tuple(t) for t in totals.collect()] == [(sid, 2, 5, 3, 2)]
    got = usage.gene_usage(usage.usage_counts(r, c)).collect()
    assert sorted((x["group_id"], x["primer"], x["gene"], x["unique_count"], x["percent"]) for x in got) == [(sid, "b1", "V1", 2, 100.0), (sid, "b2", "V1", 1, 100.0)]
    assert usage.unique_cdr3_counts(r, c).count() == 2


def test_file_matching_of_ids_without_ascii(spark):
    files = spark.createDataFrame([("/data/甲样本/r1",), ("/data/乙-D14/r1",), ("/data/样/r1",), ("/data/A1样本/r1",), ("/data/none/r1",)], "path string")
    rec = spark.createDataFrame([(1, None, "样本", ""), (2, None, "", "D14"), (3, None, "样", "－")], "record_id bigint, note string, sample_id string, dual_index string")
    got = sorted((r["path"], r["record_id"] or 0, r["match_method"]) for r in matching.match_files(files, rec).collect())
    assert got == [
        ("/data/A1样本/r1", 0, "error"), ("/data/none/r1", 0, "error"), ("/data/乙-D14/r1", 2, "dual_index"), ("/data/样/r1", 3, "sample_id"),
        ("/data/甲样本/r1", 1, "sample_id_multi"), ("/data/甲样本/r1", 3, "sample_id_multi"),
    ]


def _rows_out(plan):
    """Output rows of a run plan's joins, the stages' own plans included."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _rows_out(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return _rows_out(plan.plan())
    own = [plan.metrics().apply("numOutputRows").value()] if name.endswith("JoinExec") else []
    return own + [n for i in range(plan.children().size()) for n in _rows_out(plan.children().apply(i))]


@pytest.mark.parametrize("note", ["/srv/runs", None])
def test_records_of_one_note_are_not_paired_with_all_its_files(spark, note):
    n = 120
    files = spark.createDataFrame([(f"/srv/runs/2026/lib-{i}_R1",) for i in range(n)] + [("/srv/runs/2026/none",), ("/else/lib-1",)], "path string")
    rec = spark.createDataFrame([(i, note, f"LIB-{i}", f"lib_{i}") for i in range(n)], "record_id int, note string, sample_id string, dual_index string")
    out = matching.match_files(files, rec)
    got = {(r["path"], r["record_id"], r["match_method"], r["error"]) for r in out.collect()}
    want = {(f"/srv/runs/2026/lib-{i}_R1", i, "sample_id", "") for i in range(n)} | {("/srv/runs/2026/none", None, "error", "no dual index matches")}
    assert got == want | {("/else/lib-1", None, "error", "no note matches") if note else ("/else/lib-1", 1, "sample_id", "")}
    joined = _rows_out(out._jdf.queryExecution().executedPlan())
    assert joined and max(joined) <= 3 * n  # not n * n


def test_paths_without_components_match_no_note(spark):
    files = spark.createDataFrame([("",), ("/",), ("/a/S1",), (None,)], "path string")
    rec = spark.createDataFrame([(1, "a", "S1", "")], "record_id int, note string, sample_id string, dual_index string")
    got = {(r["path"], r["record_id"], r["error"]) for r in matching.match_files(files, rec).collect()}
    assert got == {("/a/S1", 1, "")} | {(p, None, "no note matches") for p in ("", "/", None)}


def test_best_suffix_rejects_ties(spark):
    w = spark.createDataFrame([(1, "q/a/b/c"), (2, "x/y/z"), (3, "m/n")], "id bigint, w string")
    f = spark.createDataFrame([("r/a/b/c",), ("r/z/b/c",), ("1/y/z",), ("2/y/z",)], "path string")
    got = {r["id"]: (r["path"], r["score"]) for r in matching.best_suffix(w, f, "id", "w", "path").collect()}
    assert got == {1: ("r/a/b/c", 3), 2: (None, None), 3: (None, None)}


def test_clones_and_treemap(spark):
    df = spark.createDataFrame([("s", "IGH", "T", "V", "J", c) for c in "AABBBC"] + [("s", "IGH", "F", "V", "J", "Z"), ("s", "IGH", "T", "V", "J", " ")], "sample string, chain string, productive string, v_call string, j_call string, cdr3_aa string")
    top = clones.clone_top(clones.clone_counts(df, ["sample", "chain"]), ["sample", "chain"])
    rows = [(r["rank"], r["cdr3_aa"], r["record_count"], round(r["cumulative_frequency_percent"], 6)) for r in top.orderBy("rank").collect()]
    assert rows == [(1, "B", 3, 50.0), (2, "A", 2, 83.333333), (3, "C", 1, 100.0)]
    boxes = clones.treemap_layout(top, ["sample", "chain"]).collect()
    assert abs(sum(b["w"] * b["h"] for b in boxes) - 10_000) < 1e-6


def test_treemap_holds_every_clone_in_its_cell(spark):
    counts = [("s", f"V{i % 3}", f"J{i % 2}" if i % 5 else None, f"C{i:04d}", 1 + 400 // (i + 1)) for i in range(1300)] + [("t", "V", "J", "A", 1)]
    top = clones.clone_top(spark.createDataFrame(counts, "sample string, v_call string, j_call string, cdr3_aa string, record_count bigint"), ["sample"])
    boxes = {(r["sample"], r["rank"]): r for r in clones.treemap_layout(top, ["sample"], 60.0, 40.0).collect()}
    rows = top.collect()
    assert len(boxes) == len(rows) == 1301
    total, cells = Counter(), {}
    for r in rows:
        total[r["sample"]] += r["record_count"]
    for r in rows:
        b = boxes[r["sample"], r["rank"]]
        assert abs(b["w"] * b["h"] - 2400 * r["record_count"] / total[r["sample"]]) < 1e-6
        for level in ((r["v_call"],), (r["v_call"], r["j_call"])):
            cells.setdefault((r["sample"], *level), []).append((b["x"], b["y"], b["x"] + b["w"], b["y"] + b["h"], b["w"] * b["h"]))
    for of in cells.values():  # a V's or a V and J's clones fill one rectangle of their own
        x, y, x2, y2, area = (f(c) for f, c in zip((min, min, max, max, sum), zip(*of)))
        assert abs((x2 - x) * (y2 - y) - area) < 1e-6


def test_treemap_as_the_reference_lays_it(spark):
    top = clones.clone_top(spark.createDataFrame([("s", "V", "J", c, n) for c, n in zip("ABCDEFG", (6, 6, 4, 3, 2, 2, 1))], "sample string, v_call string, j_call string, cdr3_aa string, record_count bigint"), ["sample"])
    got = {r["rank"]: tuple(round(r[c], 3) for c in "xywh") for r in clones.treemap_layout(top, ["sample"], 6.0, 4.0).collect()}
    assert got[1] == (3.0, 2.0, 3.0, 2.0) and got[2] == (3.0, 0.0, 3.0, 2.0)  # worked out in the paper on squarified treemaps
    assert got[3] == (1.286, 1.667, 1.714, 2.333) and got[4] == (0.0, 1.667, 1.286, 2.333)


def test_empty_frames(spark):
    airr = spark.createDataFrame([], "sample string, locus string, productive string, v_call string, j_call string, c_call string, cdr3_aa string, umi_counts bigint")
    assert clones.clone_top(clones.clone_counts(airr, ["sample"]), ["sample"]).count() == 0
    assert diversity.diversity(airr, ["sample"]).count() == 0
    assert diversity.expression(airr, ["sample"]).count() == 0
    assert bcell.switch_pairs(airr, ["sample"]).count() == 0


def test_session_and_daily_windows(spark):
    from vdjloom.streaming import windows

    e = spark.createDataFrame([(1, datetime(2026, 1, 1, 0, 10), "a", 1.0), (1, datetime(2026, 1, 1, 0, 20), "a", 2.0), (1, datetime(2026, 1, 1, 2, 0), "b", 4.0)], "user_id bigint, ts timestamp, event_type string, value double")
    assert windows.tumbling(e).count() == 2
    assert sorted(r["events"] for r in windows.sessions(e).collect()) == [1, 2]
