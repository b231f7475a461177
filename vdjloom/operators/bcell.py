"""B-cell operators: isotypes, class switching, somatic hypermutation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vdjloom.functions.calls import AA_PLACEHOLDERS, isotype_label, unique_gene
from vdjloom.functions.text import pct


def _heavy(df: DataFrame) -> DataFrame:
    """IGH rows whose constant call is one gene that names IGH, as column gene."""
    return df.filter("locus = 'IGH'").withColumn("gene", unique_gene("c_call")).filter(F.contains(F.col("gene"), F.lit("IGH")))


def isotype_ratio(df: DataFrame, frame: list[str], weight: str = "umi_counts") -> DataFrame:
    """Per frame and C gene its part of the weight, over rows with CDR3, C gene and weight."""
    rows = _heavy(df).filter(F.col("cdr3_aa").isNotNull() & F.col(weight).isNotNull())
    g = rows.groupBy(*frame, "gene").agg(F.sum(weight).cast("bigint").alias("umi_counts"))
    total = F.sum("umi_counts").over(Window.partitionBy(*frame))
    return g.withColumn("ratio", F.when(total != 0, F.col("umi_counts").cast("double") / total.cast("double")))


def class_switching(df: DataFrame, frame: list[str], weight: str = "umi_counts") -> DataFrame:
    """Per frame the unswitched (IGHD or IGHM) and switched part of the IGH weight."""
    naive = F.contains(F.col("gene"), F.lit("IGHD")) | F.contains(F.col("gene"), F.lit("IGHM"))
    g = _heavy(df).groupBy(*frame).agg(F.sum(F.when(naive, F.col(weight)).otherwise(0)).cast("double").alias("_u"), F.sum(weight).cast("double").alias("_t"))
    u = F.when(F.col("_t") != 0, F.col("_u") / F.col("_t"))
    return g.select(*frame, u.alias("unswitched"), (1.0 - u).alias("switched"))


def switch_pairs(df: DataFrame, frame: list[str], weight: str = "umi_counts") -> DataFrame:
    """(*frame, csr_name, ratio): for CDR3s with more than one row, the weight of every
    pair of C genes that share the CDR3, over all IGH weight.

    The pairs are of the genes of one CDR3, of which there are a handful (the IGH constant
    genes), not of its rows: rows are summed to (CDR3, gene) first.
    """
    rows = _heavy(df)
    per = rows.filter("cdr3_aa is not null").groupBy(*frame, "cdr3_aa", "gene").agg(F.sum(weight).alias("u"), F.count(F.lit(1)).alias("k"))
    genes = per.groupBy(*frame, "cdr3_aa").agg(F.array_sort(F.collect_list(F.struct("gene", "u"))).alias("g"), F.sum("k").alias("k")).filter((F.col("k") > 1) & (F.size("g") > 1))
    pairs = F.flatten(F.transform("g", lambda a: F.transform(F.filter("g", lambda b: b["gene"] > a["gene"]), lambda b: F.struct(F.concat(a["gene"], F.lit("-"), b["gene"], F.lit("_CSR_ratio")).alias("n"), (a["u"] + b["u"]).alias("u")))))
    sums = genes.select(*frame, F.explode(pairs).alias("p")).groupBy(*frame, F.col("p.n").alias("csr_name")).agg(F.sum("p.u").cast("double").alias("_s"))
    total = rows.groupBy(*(F.col(f).alias(f"__{f}") for f in frame)).agg(F.sum(weight).cast("double").alias("_t"))
    same = F.lit(True)
    for f in frame:
        same = same & F.col(f).eqNullSafe(F.col(f"__{f}"))
    return sums.join(total, same).select(*frame, "csr_name", F.when(F.col("_t") != 0, F.col("_s") / F.col("_t")).alias("ratio"))


# --- somatic hypermutation ---------------------------------------------------------------------

# The scores of the global alignment, doubled so that they are whole numbers
# (match 2, mismatch -1, opening a gap -2, extending it -0.5).
MATCH, MISMATCH, GAP_OPEN, GAP_EXTEND = 4, -2, -4, -1
BATCH_CELLS = 24_000_000  # cells of the tables that are filled at once
BATCH_PAIRS = 4096
KNOWN_PAIRS = 100_000  # results that a task keeps for pairs it meets again
_GAP = ord("-")
Result = tuple[int, int, int, int, float]


class _Batch:
    """The tables of several pairs at once: best scores S[state, i, t, pair] of all prefixes, in rows of the sequence. States: 0 a pair
    of characters, 1 a germline character alone (gap in the sequence), 2 a sequence character alone. A row holds
    every germline position (t = j), or, in a band, those next to the diagonal (t = j - i + band)."""

    def __init__(self, pairs: list[tuple[str, str]], band: int = 0):
        self.n, self.m = np.array([len(a) for a, _ in pairs]), np.array([len(b) for _, b in pairs])
        k, rows, cols = len(pairs), int(self.n.max()), int(self.m.max())
        self.a, self.b = np.zeros((max(1, rows), k), np.uint32), np.ones((max(1, cols), k), np.uint32)  # the padding never matches
        cols = self.b.shape[0]
        for x, (s, g) in enumerate(pairs):
            self.a[: len(s), x] = np.frombuffer(s.encode("utf-32-le"), np.uint32)
            self.b[: len(g), x] = np.frombuffer(g.encode("utf-32-le"), np.uint32)
        self.band, self.width = band, 2 * band + 1 if band else cols + 1
        self.near = np.pad(self.b, ((band, band + max(0, rows - cols) + 1), (0, 0)), constant_values=1) if band else self.b
        short = 2 * (rows + cols) * MATCH < 30_000  # no score of such pairs leaves 16 bits
        self.kind = np.dtype(np.int16 if short else np.int32)
        self.low = self.kind.type(-16_000 if short else -(10**9))
        self.steps = (np.arange(1, self.width) * GAP_EXTEND).astype(self.kind)[:, None]

    def first(self) -> np.ndarray:
        row = np.full((3, self.width, len(self.n)), self.low, self.kind)
        at = self.band
        row[0, at] = 0
        row[1, at + 1 :] = (GAP_OPEN + GAP_EXTEND * np.arange(self.width - at - 1))[:, None]
        return row

    def fill(self, row: np.ndarray, lo: int, hi: int, keep: bool = True) -> np.ndarray:
        """Rows lo to hi from row lo: all of them, or only the last."""
        hit, miss, open_, extend = map(self.kind.type, (MATCH - MISMATCH, MISMATCH, GAP_OPEN, GAP_EXTEND))
        S = np.full((3, hi - lo + 1 if keep else 2, *row.shape[1:]), self.low, self.kind)
        S[:, 0] = row
        for i in range(lo + 1, hi + 1):
            row, new = (S[:, i - lo - 1], S[:, i - lo]) if keep else (S[:, (i - lo - 1) % 2], S[:, (i - lo) % 2])
            both = np.maximum(row[0], row[1])
            any_ = np.maximum(both, row[2])
            both += open_
            gap = np.maximum(both, row[2] + extend)
            germline = self.near[i - 1 : i - 1 + self.width] if self.band else self.b
            score = np.multiply(germline == self.a[i - 1], hit, dtype=self.kind)
            score += miss
            if self.band:
                np.add(any_, score, out=new[0])
                new[2, :-1], new[2, -1] = gap[1:], self.low
            else:
                new[0, 0] = self.low
                np.add(any_[:-1], score, out=new[0, 1:])
                new[2] = gap
            # gaps along the row: the best opening so far, by a running maximum
            opening = np.maximum(new[0, :-1], new[2, :-1])
            opening += open_
            opening -= self.steps
            np.maximum.accumulate(opening, axis=0, out=opening)
            np.add(opening, self.steps, out=new[1, 1:])
            new[1, 0] = self.low
        return S if keep else S[:, (hi - lo) % 2].copy()

    def start(self, S: np.ndarray, lo: int) -> None:
        """Begins the way back at each pair's end."""
        k = len(self.n)
        self.i, self.j = self.n.copy(), self.m.copy()
        self.counts = np.zeros((4, k), np.int64)  # mismatches, insertions, deletions, columns with two characters
        self.state = np.argmax(S[:, self.i - lo, self._t(self.i, self.j), np.arange(k)], axis=0)

    def _t(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return j - i + self.band if self.band else j

    def back(self, S: np.ndarray, lo: int) -> None:
        """The way back of all pairs through the rows from lo on, a step of each at a time. Among equally good steps
        a pair of characters comes first, then a gap in the sequence, then one in the germline."""
        x = np.flatnonzero((self.i > lo) | ((lo == 0) & (self.j > 0)))
        while len(x):
            i, j, state = self.i[x], self.j[x], self.state[x]
            here = S[state, i - lo, self._t(i, j), x]
            s = np.where(state == 1, _GAP, self.a[i - 1, x])
            g = np.where(state == 2, _GAP, self.b[j - 1, x])
            s_gap, g_gap = s == _GAP, g == _GAP
            both = ~(s_gap | g_gap)
            self.counts[:, x] += np.stack([both & (s != g), g_gap & ~s_gap, s_gap & ~g_gap, both])
            i, j = i - (state != 1), j - (state != 2)
            P, Q, R = S[:, i - lo, self._t(i, j), x]
            paired = np.where(P >= np.maximum(Q, R), 0, np.where(Q >= R, 1, 2))
            if (state == 0).all():
                self.state[x] = paired
            else:
                gapped = np.where(P + GAP_OPEN == here, 0, np.where((state == 1) & (R + GAP_OPEN == here), 2, np.where((state == 2) & (Q + GAP_OPEN == here), 1, state)))
                self.state[x] = np.where(state == 0, paired, gapped)
            self.i[x], self.j[x] = i, j
            x = x[(i > lo) | ((lo == 0) & (j > 0))]

    def results(self) -> list[Result]:
        out = []
        for mm, ins, dele, both in self.counts.T.tolist():
            total, base = mm + ins + dele, both + ins + dele
            out.append((mm, ins, dele, total, total / base if base else 0.0))
        return out


def _align_batch(pairs: list[tuple[str, str]], band: int) -> list[Result]:
    """Pairs whose tables fit in BATCH_CELLS, or one larger pair, of which every so many rows are kept and the rows between
    filled once more on the way back."""
    t = _Batch(pairs, band)
    rows = int(t.n.max())
    row = 3 * len(pairs) * t.width
    if row * (rows + 1) <= BATCH_CELLS:
        S = t.fill(t.first(), 0, rows)
        t.start(S, 0)
        t.back(S, 0)
        return t.results()
    step = max(1, int(rows**0.5))
    kept = [t.first()]
    for lo in range(0, rows - 1, step):
        if lo + step < rows:
            kept.append(t.fill(kept[-1], lo, lo + step, keep=False))
    for k in range(len(kept) - 1, -1, -1):
        lo = k * step
        S = t.fill(kept.pop(), lo, min(rows, lo + step))
        if lo + step >= rows:
            t.start(S, lo)
        t.back(S, lo)
    return t.results()


def align_all(pairs: list[tuple[str, str]]) -> list[Result]:
    """(mismatches, insertions, deletions, total, ratio) of each pair's best global alignment with affine gaps.

    Among equally good alignments the traceback prefers, from the end, a pair of characters, then a
    gap in the sequence, then one in the germline. '-' is a character of the input like any other;
    it is classified after aligning: '-' against a base is a deletion, a base against '-' an insertion, '-'
    against '-' nothing.

    Texts of one length n with d differences score 2n - 3d character by character (in points of a match being 2). An
    alignment that leaves the diagonal by g has g gaps on each side and scores 2n - 3g - 3 at most. So with d of 1
    nothing is better than character by character, and with more every best alignment stays within d of the
    diagonal: only that band is filled. Pairs of like length are filled together. A pair of any length takes memory in
    proportion to its length times the square root of it.
    """
    out: list = [None] * len(pairs)
    todo = []
    for k, (s, g) in enumerate(pairs):
        d = sum(map(str.__ne__, s, g)) if len(s) == len(g) else -1
        if 0 <= d <= 1:
            kept = [(x, y) for x, y in zip(s, g) if x != "-" or y != "-"]
            dele, ins = sum(x == "-" for x, _ in kept), sum(y == "-" for _, y in kept)
            mm = sum(x != y for x, y in kept) - dele - ins
            out[k] = (mm, ins, dele, mm + ins + dele, (mm + ins + dele) / len(kept) if kept else 0.0)
        else:
            band = d if 0 < 2 * d < len(g) else 0
            todo.append((band, len(s), len(g), k))
    todo.sort()
    while todo:
        band, now = todo[-1][0], []
        n = m = 0
        while todo and len(now) < BATCH_PAIRS:
            b, x, y, k = todo[-1]
            if (b == 0) != (band == 0):
                break
            n, m = max(n, x), max(m, y)
            if now and 3 * (n + 1) * (2 * band + 1 if band else m + 1) * (len(now) + 1) > BATCH_CELLS:
                break
            now.append(k)
            todo.pop()
        for k, r in zip(now, _align_batch([pairs[k] for k in now], band)):
            out[k] = r
    return out


def align(seq: str, germline: str) -> Result:
    return align_all([(seq, germline)])[0]


_SHM = "struct<shm: int, ratio: double>"


def aligned(*texts: tuple[Column, Column]) -> Column:
    """A struct s0, s1, ... of (shm, ratio), one for each pair (sequence, germline) of columns; null where either is null. Rows are aligned where they
    are, in Arrow batches; a pair that a task meets again is not aligned again."""
    kind = "struct<" + ", ".join(f"s{i}: {_SHM}" for i in range(len(texts))) + ">"

    def work(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        known: dict[tuple[str, str], dict] = {}
        for cols in parts:
            keys = [[None if a is None or b is None else (a, b) for a, b in zip(cols[2 * i], cols[2 * i + 1])] for i in range(len(cols) // 2)]
            if len(known) > KNOWN_PAIRS:
                known.clear()
            new = list({k for ks in keys for k in ks if k is not None and k not in known})
            known.update(zip(new, ({"shm": r[3], "ratio": r[4]} for r in align_all(new))))
            yield pd.DataFrame({f"s{i}": [None if k is None else known[k] for k in ks] for i, ks in enumerate(keys)})

    work.__annotations__ = {"parts": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(work, kind)(*(c for p in texts for c in p))


def with_shm(df: DataFrame) -> DataFrame:
    """A08's input: df with v_shm, v_shm_ratio, tt_shm, tt_shm_ratio, for IGH, IGK and IGL rows with
    numeric V coordinates (others get nulls). The V span is cut from both alignment strings. Nothing is moved."""
    ok = F.col("locus").isin("IGH", "IGK", "IGL") & F.col("v_alignment_start").isNotNull() & F.col("v_alignment_end").isNotNull()
    span = lambda c: F.when(ok, F.col(c).substr(F.col("v_alignment_start"), F.greatest(F.lit(0), F.col("v_alignment_end") - F.col("v_alignment_start") + 1)))
    whole = lambda c: F.when(ok, F.col(c))
    r = df.withColumn("__shm", aligned((span("sequence_alignment"), span("germline_alignment")), (whole("sequence_alignment"), whole("germline_alignment"))))
    get = lambda p: F.col(f"__shm.{p}")
    return r.select(*(F.col(f"`{c}`") for c in df.columns), get("s0.shm").alias("v_shm"), get("s0.ratio").alias("v_shm_ratio"), get("s1.shm").alias("tt_shm"), get("s1.ratio").alias("tt_shm_ratio"))


def _weighted(x: str, w: str) -> Column:
    t = F.sum(F.coalesce(F.col(w), F.lit(0)))
    return F.when(t != 0, F.sum(F.coalesce(F.col(x), F.lit(0)) * F.coalesce(F.col(w), F.lit(0))) / t)


def shm_shares(df: DataFrame, frame: list[str], weight: str = "umi_counts") -> DataFrame:
    """Per frame the mutated and unmutated parts of the IGH weight (V and whole, all and naive)."""
    rows = df.filter("locus = 'IGH'").withColumn("_g", unique_gene("c_call"))
    naive = F.coalesce(F.contains(F.col("_g"), F.lit("IGHD")) | F.contains(F.col("_g"), F.lit("IGHM")), F.lit(False))
    out = []
    for side in ("v", "tt"):
        for name, cond in (("", F.lit(True)), ("naive_", naive)):
            t = F.sum(F.when(cond, F.col(weight)))
            hit = lambda c: F.coalesce(F.sum(F.when(cond & c, F.col(weight))), F.lit(0))  # noqa: E731, B023
            out.append(F.when(t != 0, hit(F.col(f"{side}_shm") != 0) / t).alias(f"{side}_{name}mutated"))
            out.append(F.when(t != 0, hit(F.col(f"{side}_shm") == 0) / t).alias(f"{side}_{name}unmutated"))
    return rows.groupBy(*frame).agg(*out)


def shm_by_locus(df: DataFrame, frame: list[str], weight: str = "umi_counts") -> DataFrame:
    """Weighted means per locus (null values count as 0; no weight gives null)."""
    cols = ("v_shm", "v_shm_ratio", "tt_shm", "tt_shm_ratio")
    return df.groupBy(*frame, "locus").agg(*(_weighted(c, weight).alias(c) for c in cols))


def shm_by_isotype(df: DataFrame, frame: list[str], weight: str = "umi_counts") -> DataFrame:
    """Per C gene the plain mean of value * copies, and what the report shows: that
    mean times the records over the copies in percent, IGHD and IGHM pooled as IgD/M (null outside 0-100)."""
    rows = _heavy(df)
    cols = ("v_shm", "v_shm_ratio", "tt_shm", "tt_shm_ratio")
    per = rows.groupBy(*frame, "gene").agg(*(F.avg(F.col(c) * F.col(weight)).alias(c) for c in cols), F.count(F.lit(1)).alias("records"), F.sum(weight).alias("copies"))
    title = F.when(F.col("gene").isin("IGHD", "IGHM"), "IgD/M").otherwise(isotype_label("gene"))
    shown = per.groupBy(*frame, title.alias("_title")).agg((F.sum(F.col("v_shm_ratio") * F.col("records")) / F.sum("copies") * 100).alias("mean_shm_percent"))
    shown = shown.withColumn("mean_shm_percent", F.when(F.col("mean_shm_percent").between(0, 100), F.col("mean_shm_percent")))
    return per.withColumn("_title", title).join(shown, [*frame, "_title"], "left").withColumnRenamed("_title", "isotype")


# --- composition: isotypes of the sample records of a group --------------------------------------


def isotype_summary(records: DataFrame) -> DataFrame:
    """Per group and main class its weight (metric abundance) and its distinct valid CDR3s (metric
    unique_cdr3), each with its denominator, and the group's totals. records: eligible sample
    records (group_id, weight, isotype_main, aa_field, aa_value, aa_valid). Groups with no valid
    CDR3 but the field present give one zero row with an empty class. Null classes count as ''.
    """
    r = records.withColumn("isotype_main", F.coalesce("isotype_main", F.lit("")))
    total = r.groupBy(F.col("group_id").alias("_g")).agg(
        F.coalesce(F.sum("weight"), F.lit(0)).alias("total_records"), F.coalesce(F.sum(F.when(F.col("isotype_main") != "", F.col("weight"))), F.lit(0)).alias("annotated_records"),
        F.max(F.when(F.col("aa_field") == "cdr3_aa", 1).otherwise(0)).alias("_has"),
    )
    named = r.filter("isotype_main <> ''")
    whole = Window.partitionBy("group_id")
    ab = named.groupBy("group_id", F.col("isotype_main").alias("isotype")).agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("count"))
    ab = ab.withColumn("denominator", F.sum("count").over(whole)).join(total, F.col("group_id") == F.col("_g")).select(
        "group_id", F.lit("abundance").alias("metric"), "isotype", "count", "denominator", pct(F.col("count"), F.col("denominator")).alias("percent"),
        "total_records", "annotated_records", (F.col("total_records") - F.col("annotated_records")).alias("excluded_records"),
        F.lit(None).cast("bigint").alias("valid_aa_records"), F.lit(None).cast("bigint").alias("global_unique_cdr3"),
    )
    valid = named.filter("aa_field = 'cdr3_aa' and aa_valid = 1")
    per_value = valid.groupBy("group_id", "isotype_main", "aa_value").agg(F.sum("weight").alias("w"))
    un = per_value.groupBy("group_id", F.col("isotype_main").alias("isotype")).agg(F.count("aa_value").alias("count"))
    once = per_value.groupBy("group_id", "aa_value").agg(F.sum("w").alias("w"))
    glob = once.groupBy(F.col("group_id").alias("_gg")).agg(F.count("aa_value").alias("global_unique_cdr3"), F.coalesce(F.sum("w"), F.lit(0)).alias("valid_aa_records"))
    un = un.withColumn("denominator", F.sum("count").over(whole))
    u = total.filter("_has = 1").join(un, F.col("group_id") == F.col("_g"), "left").join(glob, F.col("_g") == F.col("_gg"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    un = u.select(
        F.col("_g").alias("group_id"), F.lit("unique_cdr3").alias("metric"), F.coalesce("isotype", F.lit("")).alias("isotype"), zero("count").alias("count"), zero("denominator").alias("denominator"),
        pct(F.col("count"), F.col("denominator")).alias("percent"), "total_records", "annotated_records", (F.col("total_records") - zero("valid_aa_records")).alias("excluded_records"),
        zero("valid_aa_records").alias("valid_aa_records"), zero("global_unique_cdr3").alias("global_unique_cdr3"),
    )
    return ab.unionByName(un)


def _constant_members(records: DataFrame, calls: DataFrame) -> DataFrame:
    c = calls.filter("segment = 'C' and assignment = 'unique'").select(F.col("record_id").alias("_r"), "gene")
    return records.filter("isotype_main <> ''").join(c, F.col("id") == F.col("_r"))


def isotype_distribution(records: DataFrame, calls: DataFrame) -> DataFrame:
    """Per group and C gene records, copies, distinct valid CDR3s, and both shares in percent."""
    m = _constant_members(records, calls)
    per = m.groupBy("group_id", "gene", F.when(F.col("aa_valid") == 1, F.col("aa_value")).alias("_v")).agg(F.count(F.lit(1)).alias("k"), F.sum("weight").alias("w"))
    g = per.groupBy("group_id", "gene").agg(F.sum("k").alias("records"), F.sum("w").alias("copies"), F.count("_v").alias("unique_cdr3"))
    whole = Window.partitionBy("group_id")
    return g.withColumn("copy_percent", pct(F.col("copies"), F.sum("copies").over(whole))).withColumn("cdr3_percent", pct(F.col("unique_cdr3"), F.sum("unique_cdr3").over(whole)))


def shared_cdr3(records: DataFrame, calls: DataFrame) -> DataFrame:
    """Per group and isotype (IGHD and IGHM pooled as IgD/M) its CDR3s and how many of them also
    occur under another isotype. A CDR3 is one row with the set of its isotypes (a handful)."""
    m = _constant_members(records, calls).filter(F.col("aa_valid") == 1).filter(F.col("aa_value").isNotNull() & ~F.lower("aa_value").isin(*AA_PLACEHOLDERS))
    title = F.when(F.col("gene").isin("IGHD", "IGHM"), "IgD/M").otherwise(isotype_label("gene"))
    per = m.select("group_id", "aa_value", title.alias("isotype")).distinct()
    sets = per.groupBy("group_id", "aa_value").agg(F.collect_set("isotype").alias("s"))
    rows = sets.select("group_id", F.explode("s").alias("isotype"), (F.size("s") > 1).cast("int").alias("other"))
    g = rows.groupBy("group_id", "isotype").agg(F.count(F.lit(1)).alias("unique_cdr3"), F.sum("other").alias("shared_cdr3"))
    return g.withColumn("shared_cdr3_percent", pct(F.col("shared_cdr3"), F.col("unique_cdr3")))
