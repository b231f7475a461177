"""Metadata matching: notes and paths, bounded ids, chain selectors, best suffix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vdjloom.operators.ranking import sequential_ids

# Fixed values.
TCR = ("TRA", "TRB", "TRD", "TRG")
BCR = ("IGH", "IGK", "IGL")
IGH_ISOTYPES = ("IGHA", "IGHD", "IGHE", "IGHG", "IGHM")


def path_parts(c: Column | str) -> Column:
    """A path's components in lower case, slashes and backslashes alike, without empty ones."""
    p = F.col(c) if isinstance(c, str) else c
    return F.filter(F.split(F.lower(F.regexp_replace(p, r"\\", "/")), "/"), lambda x: F.trim(x) != "")


def contains_run(parts: Column, run: Column) -> Column:
    """The components of `run` occur in `parts` one after the other."""
    width = F.size(run)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - width + 1))
    return (width > 0) & (width <= F.size(parts)) & F.exists(starts, lambda i: F.slice(parts, i, width) == run)


def bounded(value: Column, label: Column) -> Column:
    """The value stands in the label with no letter or digit next to it; '' never does."""
    quoted = F.regexp_replace(value, r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")
    return (value != "") & F.regexp_like(label, F.concat(F.lit("(?i)(?<![A-Za-z0-9])"), quoted, F.lit("(?![A-Za-z0-9])")))


def runs_of(parts: Column, widths: list[int]) -> Column:
    """The runs of so many components as `widths` has, each as one text with slashes between; none if there are fewer components."""
    fit = F.filter(F.array(*(F.lit(w) for w in widths)).cast("array<int>"), lambda w: w <= F.size(parts))
    return F.flatten(F.transform(fit, lambda w: F.transform(F.sequence(F.lit(1), F.size(parts) - w + 1), lambda i: F.array_join(F.slice(parts, i, w), "/"))))


def match_files(files: DataFrame, records: DataFrame, path: str = "path") -> DataFrame:
    """(path, record_id, match_method, error) for every file and record it belongs to.

    records: (record_id, note, sample_id, dual_index). Where any record has a note, a file only meets
    records whose note (one of its entries) is a run of its path's components; then the sample ids
    that stand bounded in the path match, and only if there are none the dual indexes. Several
    matches are all kept (sample_id_multi, dual_index_multi); none gives an error row.

    All is one equi-join. An id's key are its tokens (ASCII letters and digits, as the id's bounds
    are), which the path must hold as a run; ids without a token meet the paths by their first two
    characters. Where there are notes, the note entry's text is a part of the key and meets the
    path's runs of as many components: records that share a note are not paired with all its files.
    """
    entries = records.select("*", F.explode_outer(F.split(F.coalesce("note", F.lit("")), r"[\r\n;,]+")).alias("_e")).withColumn("_e", path_parts(F.regexp_replace(F.trim("_e"), '^"|"$', "")))
    notes = entries.filter(F.size("_e") > 0).withColumn("_n", F.array_join("_e", "/"))
    f = files.select(F.col(path).alias("path")).distinct()
    widths = sorted(r[0] for r in notes.select(F.size("_e")).distinct().collect())
    if widths:
        spread = f.withColumn("_p", path_parts("path")).select("path", F.explode(F.array_distinct(runs_of(F.col("_p"), widths))).alias("_n"))
        inside, owned = spread.join(notes.select("_n").distinct(), "_n", "left_semi"), notes
    else:
        inside, owned = f.withColumn("_n", F.lit("")), records.withColumn("_n", F.lit(""))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    tokens = lambda c: F.transform(F.filter(F.split(c, "[^A-Za-z0-9]+"), lambda x: x != ""), F.lower)
    key = lambda c: F.when(F.size(tokens(text(c))) > 0, F.concat(F.lit("t:"), F.array_join(tokens(text(c)), "/"))).when(text(c) != "", F.concat(F.lit("c:"), F.substring(text(c), 1, 2)))
    ids = owned.select("record_id", "sample_id", "dual_index", "_n", F.explode(F.array_distinct(F.array(key("sample_id"), key("dual_index")))).alias("_t")).filter("_t is not null")
    lengths = sorted(r[0] for r in ids.select(F.when(F.startswith("_t", F.lit("c:")), 0).otherwise(F.size(F.split("_t", "/")))).distinct().collect())
    keys = F.transform(runs_of(F.col("_w"), [n for n in lengths if n]), lambda x: F.concat(F.lit("t:"), x))
    if 0 in lengths:
        whole = F.regexp_replace("path", r"\\", "/")
        at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(whole)))
        pairs = F.flatten(F.transform(at, lambda k: F.array(F.substring(whole, k, F.lit(1)), F.substring(whole, k, F.lit(2)))))
        keys = F.concat(keys, F.transform(pairs, lambda x: F.concat(F.lit("c:"), x)))
    ft = inside.withColumn("_w", tokens(F.col("path"))).select("path", "_n", F.explode(F.array_distinct(keys)).alias("_t"))
    label = F.regexp_replace("path", r"\\", "/")
    s = ft.join(ids, ["_n", "_t"]).select("path", "record_id", "sample_id", "dual_index")
    s = s.withColumn("_sid", bounded(F.coalesce("sample_id", F.lit("")), label)).withColumn("_dual", bounded(F.coalesce("dual_index", F.lit("")), label)).filter("_sid or _dual").distinct()
    w = Window.partitionBy("path")
    s = s.withColumn("_ns", F.sum(F.col("_sid").cast("int")).over(w)).withColumn("_nd", F.sum(F.col("_dual").cast("int")).over(w))
    hit = s.filter(F.col("_sid") | ((F.col("_ns") == 0) & F.col("_dual")))
    method = F.when(F.col("_ns") == 1, "sample_id").when(F.col("_ns") > 1, "sample_id_multi").when(F.col("_nd") == 1, "dual_index").otherwise("dual_index_multi")
    out = f.join(hit.select("path", "record_id", method.alias("match_method")), "path", "left")
    why = F.lit("no dual index matches")
    if widths:
        out = out.join(inside.select("path").distinct().withColumn("_in", F.lit(1)), "path", "left")
        why = F.when(F.col("_in").isNull(), "no note matches").otherwise(why)
    lost = F.col("match_method").isNull()
    return out.select("path", "record_id", F.when(lost, "error").otherwise(F.col("match_method")).alias("match_method"), F.when(lost, why).otherwise("").alias("error"))


def expand_chains(c: Column | str) -> Column:
    """struct(audit, database): the chains a selector asks for, as ordered distinct arrays. 7C and BOTH are all
    chains, T and B one side, IGH* and single isotypes search IGH. Both are null if any token is unknown or none is given."""
    col = F.col(c) if isinstance(c, str) else c
    t = F.filter(F.split(F.regexp_replace(F.upper(col), "＊", "*"), r"[+,;/|\s]+"), lambda x: x != "")
    arr = lambda xs: F.array(*(F.lit(x) for x in xs))
    audit = lambda x: F.when(x.isin("7C", "BOTH"), arr(TCR + BCR)).when(x.isin("T", "TCR"), arr(TCR)).when(x.isin("B", "BCR"), arr(BCR)).when(x == "IGH*", arr(IGH_ISOTYPES)).otherwise(F.array(x))
    base = lambda x: F.when(x.isin("7C", "BOTH"), arr(BCR + TCR)).when(x.isin("T", "TCR"), arr(TCR)).when(x.isin("B", "BCR"), arr(BCR)).when((x == "IGH*") | x.isin(*IGH_ISOTYPES), arr(("IGH",))).otherwise(F.array(x))
    known = ("7C", "BOTH", "T", "TCR", "B", "BCR", "IGH*", *TCR, *BCR, *IGH_ISOTYPES)
    ok = (F.size(t) > 0) & ~F.exists(t, lambda x: ~x.isin(*known))
    return F.struct(F.when(ok, F.array_distinct(F.flatten(F.transform(t, audit)))).alias("audit"), F.when(ok, F.array_distinct(F.flatten(F.transform(t, base)))).alias("database"))


def best_suffix(wanted: DataFrame, files: DataFrame, key: str, wanted_path: str, path: str, least: int = 2) -> DataFrame:
    """(key, path, score): for each wanted path the file that shares the most components from the end; null where
    the best score is below `least` or held by several. Files and wanted paths meet on their last two components."""
    tail = lambda c: F.array_join(F.slice(F.reverse(path_parts(c)), 1, least), "/")
    a = wanted.select(F.col(key), F.reverse(path_parts(wanted_path)).alias("_a"), tail(wanted_path).alias("_ta"))
    b = files.select(F.col(path).alias("path"), F.reverse(path_parts(path)).alias("_b"), tail(path).alias("_tb")).distinct()
    equal = F.zip_with("_a", "_b", lambda x, y: F.coalesce(x == y, F.lit(False)))
    first_miss = F.array_position(equal, False)
    same = F.when(first_miss == 0, F.size(equal)).otherwise(first_miss - 1).cast("int")
    j = a.join(b, F.col("_ta") == F.col("_tb")).withColumn("score", same).filter(F.col("score") >= least)
    w = Window.partitionBy(key)
    top = j.withColumn("_m", F.max("score").over(w)).filter("score = _m")
    g = top.groupBy(key).agg(F.count(F.lit(1)).alias("_k"), F.min("path").alias("path"), F.max("score").alias("score"))
    return wanted.select(key).join(g.filter("_k = 1").drop("_k"), key, "left")


def missing_tasks(selected: DataFrame, available: DataFrame, keys: list[str]) -> DataFrame:
    """Selected keys that are not available."""
    return selected.select(*keys).distinct().join(available.select(*keys).distinct(), keys, "left_anti")


def shared_sources(rows: DataFrame, source: str, owner: str) -> DataFrame:
    """Sources with more than one owner."""
    return rows.groupBy(source).agg(F.min(owner).alias("a"), F.max(owner).alias("b")).filter("a <> b").select(source)


def input_mode(flags: DataFrame, file: str, order: str, raw: str, first: int = 64) -> DataFrame:
    """per file raw or presplit from its first 64 pairs; mixed where they disagree. Looking at a file's head is the feature."""
    w = Window.partitionBy(file).orderBy(order)
    head = flags.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= first)
    g = head.groupBy(file).agg(F.min(F.col(raw).cast("int")).alias("lo"), F.max(F.col(raw).cast("int")).alias("hi"))
    return g.select(file, F.when(F.col("lo") != F.col("hi"), "mixed").when(F.col("lo") == 1, "raw").otherwise("presplit").alias("mode"))


def largest_first(tasks: DataFrame, size: str, key: list[str]) -> DataFrame:
    """Tasks with task_order, the order in which they are to be started: the largest first, then by key. Null sizes come last.
    Tasks of any number: see running()."""
    return sequential_ids(tasks, [F.col(size).desc_nulls_last(), *(F.asc(k) for k in key)], 1, "task_order")
