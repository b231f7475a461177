"""Published evidence, task plans, previews and snapshots."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vdjloom.schemas import CHAINS
from vdjloom.sources.sinks import write_bytes


def published(runs: DataFrame, receipts: DataFrame, now: DataFrame) -> DataFrame:
    """(run_id, published): a run is published if it is DONE and every file of its receipts is there unchanged.
    runs: (run_id, state); receipts: (run_id, path, size, sha256); now: (path, size, sha256)."""
    n = now.select(F.col("path").alias("_p"), F.col("size").alias("_s"), F.col("sha256").alias("_h"))
    ok = F.coalesce((F.col("size") == F.col("_s")) & (F.col("sha256") == F.col("_h")), F.lit(False))
    per = receipts.join(n, F.col("path") == F.col("_p"), "left").groupBy(F.col("run_id").alias("_r")).agg(F.min(ok).alias("_ok"))
    return runs.join(per, F.col("run_id") == F.col("_r"), "left").select("run_id", ((F.col("state") == "DONE") & F.coalesce("_ok", F.lit(False))).alias("published"))


def composition_source(items: DataFrame, manifest: DataFrame, done: DataFrame, outputs: DataFrame | None = None) -> DataFrame:
    """(sample, chain, status): complete if the selected items lie in one folder that has been published, whose manifest has
    exactly one OK row for the sample, naming exactly the selected paths, and whose output is as its receipt says; else the first
    reason that holds. items: (sample, chain, folder, path); done: (folder, published).
    manifest: (folder, sample, chain, status, path) and, where a manifest row names several chains or paths and so takes several
    rows here, row (its number); without it each row is one of its chain. path may be several, joined by ';'.
    outputs: (folder, sample, chain, size, modified, receipt_size, receipt_modified), null where there is none; not given: not checked."""
    sel = items.groupBy("sample", "chain").agg(F.min("folder").alias("folder"), F.count("folder").alias("_f"), F.count(F.lit(1)).alias("_n"), F.countDistinct("folder").alias("_k"), F.array_sort(F.collect_set("path")).alias("_want"))
    good = manifest.filter("status = 'OK'")
    whole = ["folder", "sample"] if "row" in manifest.columns else ["folder", "sample", "chain"]
    n = F.countDistinct("row") if "row" in manifest.columns else F.count(F.lit(1))
    paths = good.select("folder", "sample", "chain", F.explode_outer(F.filter(F.split("path", ";"), lambda x: x != "")).alias("path"))
    have = paths.groupBy("folder", "sample", "chain").agg(F.array_sort(F.collect_set("path")).alias("_have"))
    rows = good.groupBy(*whole).agg(n.alias("_rows")).select(*(F.col(c).alias(f"_r{c}") for c in whole), "_rows")
    m = have.select(F.col("folder").alias("_mf"), F.col("sample").alias("_ms"), F.col("chain").alias("_mc"), "_have")
    d = done.select(F.col("folder").alias("_df"), "published")
    j = sel.join(m, (F.col("folder") == F.col("_mf")) & (F.col("sample") == F.col("_ms")) & (F.col("chain") == F.col("_mc")), "left").join(d, F.col("folder") == F.col("_df"), "left")
    same = F.lit(True)
    for c in whole:
        same = same & (F.col(c) == F.col(f"_r{c}"))
    j = j.join(rows, same, "left")
    proved = F.lit(True)
    if outputs is not None:
        one = (F.col("size") == F.col("receipt_size")) & (F.col("modified") == F.col("receipt_modified"))
        o = outputs.groupBy(F.col("folder").alias("_of"), F.col("sample").alias("_os"), F.col("chain").alias("_oc")).agg(F.min(F.coalesce(one, F.lit(False))).alias("_proved"))
        j = j.join(o, (F.col("folder") == F.col("_of")) & (F.col("sample") == F.col("_os")) & (F.col("chain") == F.col("_oc")), "left")
        proved = F.coalesce("_proved", F.lit(False))
    status = (
        F.when(F.col("_f") < F.col("_n"), "preprocessing_source_unavailable").when(F.col("_k") > 1, "multiple_preprocessing_sources")
        .when(F.col("published").isNull(), "preprocessing_unavailable").when(~F.col("published"), "preprocessing_not_published")
        .when(F.coalesce("_rows", F.lit(0)) != 1, "preprocessing_sample_unverified")
        .when(F.coalesce(F.col("_have") != F.col("_want"), F.lit(True)), "preprocessing_scope_unverified").when(~proved, "preprocessing_output_unverified").otherwise("complete")
    )
    return j.select("sample", "chain", status.alias("status"))


def task_plan(summary: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """(task_id, sample_id, pair_id, chain, label, sources, fingerprint): a task per sample, pair and chain with its source paths.
    Failed or unknown rows among the selected raise; so do selected tasks without a result. Labels that differ only
    in case, or become equal when cleaned, get 12 digits of a hash."""
    key = ["sample_id", "pair_id", "chain"]
    rows = summary.withColumn("chain", F.upper(F.trim("chain")))
    if selected is not None:
        lost = selected.select(*key).join(rows.select(*key), key, "left_anti").limit(1).count()
        if lost:
            raise ValueError("selected results are missing from the summary")
        rows = rows.join(selected.select(*key).distinct(), key, "left_semi")
    good = (F.col("sample_id") != "") & F.col("chain").isin(*CHAINS) & (F.upper("status") == "OK") & (F.coalesce("output_path", F.lit("")) != "")
    checked = rows.withColumn("output_path", F.when(F.coalesce(good, F.lit(False)), F.col("output_path")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("invalid or failed result:"), *key)).cast("string")))
    t = checked.groupBy(*key).agg(F.array_sort(F.collect_set("output_path")).alias("sources"))
    clean = F.substring(F.regexp_replace("sample_id", r"[^\p{L}\p{N}_.\-]", "_"), 1, 80)
    names = t.select("sample_id", "pair_id", F.lower(clean).alias("_l")).distinct().groupBy("_l").agg((F.count(F.lit(1)) > 1).alias("_twice"))
    digest = lambda *c: F.sha2(F.concat_ws("\x00", *c), 256)
    t = t.withColumn("_c", clean).join(names, F.lower("_c") == F.col("_l"))
    label = F.when(F.col("_twice"), F.concat("_c", F.lit("_"), F.substring(digest("sample_id", "pair_id"), 1, 12))).otherwise(F.col("_c"))
    return t.select(digest(*key).alias("task_id"), *key, label.alias("label"), "sources", digest(*key, F.array_join("sources", "\n")).alias("fingerprint"))


def assert_totals(parts: DataFrame, total: DataFrame, keys: list[str], part: str, whole: str) -> DataFrame:
    """parts' sums per key with the expected total; a key whose sum differs fails the job."""
    s = parts.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(F.sum(part).alias("_s"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    j = total.join(s, same, "left")
    ok = F.coalesce(F.col("_s"), F.lit(0)) == F.col(whole)
    return j.select(*keys, F.when(ok, F.col(whole)).otherwise(F.raise_error(F.lit(f"{part} does not add up to {whole}")).cast("bigint")).alias(whole))


def version_of(receipts: DataFrame, query: str = "", errors_only: bool = False) -> str:
    """One hash for the state of the files behind a preview (their paths, sizes and times) and its filter."""
    one = F.concat_ws("|", "path", F.col("size").cast("string"), F.col("modified").cast("string"))
    files = receipts.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(one)), "\n"), 256)).first()[0]
    return hashlib.sha256(json.dumps([files, query, errors_only]).encode()).hexdigest()


def preview(df: DataFrame, key: str, version: str, cursor: dict | None = None, size: int = 50, query: str = "", errors_only: bool = False) -> tuple[list, dict | None]:
    """(rows, next cursor) of the page after the cursor, by key. A cursor of another version raises: the files or the
    filter have changed. The cursor is None on the last page. size is kept within 1 and 200."""
    from vdjloom.operators.ranking import search

    if cursor and cursor["version"] != version:
        raise ValueError("the result or its filter has changed; load the first page again")
    rows = df.filter(F.upper("status") == "ERROR") if errors_only else df
    rows = search(rows, query) if query else rows
    rows = rows.filter(F.col(key) > F.lit(cursor["after"])) if cursor else rows
    size = min(200, max(1, size))
    page = rows.orderBy(key).limit(size + 1).collect()
    more = len(page) > size
    return page[:size], {"version": version, "after": page[size - 1][key]} if more else None


def exports(usage: DataFrame) -> dict[str, DataFrame]:
    """The six gene-usage views: sample and primer usage, reference observation of both, and unobserved genes of both."""
    sample, primer = usage.filter("primer = ''"), usage.filter("primer <> ''")
    known = lambda d: d.filter("reference_catalog = 1")
    unseen = lambda d: known(d).filter("status = 'zero_observed'")
    return {
        "sample_gene_usage": sample.filter("unique_count > 0 or ambiguous_count > 0"), "primer_gene_usage": primer.filter("unique_count > 0 or ambiguous_count > 0"),
        "reference_gene_observation": known(sample), "primer_reference_gene_observation": known(primer),
        "unobserved_reference_genes": unseen(sample), "primer_unobserved_reference_genes": unseen(primer),
    }


def summary_json(tables: dict[str, DataFrame], status: str = "DONE", facts: dict[str, DataFrame] | None = None) -> str:
    """A run's status, its tables' names, columns and row counts, and its facts (the first column of each frame's rows
    names a value in the second), as JSON. All counts come from one job."""
    counts = None
    for n, t in tables.items():
        one = t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("t"), "n")
        counts = one if counts is None else counts.unionByName(one)
    rows = {r["t"]: r["n"] for r in counts.collect()} if counts is not None else {}
    known = {n: {str(r[0]): r[1] for r in f.collect()} for n, f in (facts or {}).items()}
    return json.dumps({"status": status, "tables": {n: {"columns": t.columns, "rows": rows[n]} for n, t in tables.items()}, "facts": known}, sort_keys=True, default=str)


def relabel(df: DataFrame, names: dict[str, str], values: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """Columns under the names a laboratory reads, and codes replaced by their labels (others stay)."""
    def label(c: str) -> Column:
        m = (values or {}).get(c)
        if not m:
            return F.col(c)
        pairs = [F.lit(x) for kv in m.items() for x in kv]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(c)), F.col(c))

    return df.select(*(label(c).alias(n) for c, n in names.items() if c in df.columns))


def wide_matching(summary: DataFrame, keys: list[str]) -> DataFrame:
    """The three match percentages of a group side by side, with its denominator and unassessed rows."""
    v = lambda c: F.max(F.when(F.col("match_class") == c, F.col("percent"))).alias(f"{c}_percent")
    return summary.groupBy(*keys).agg(F.max("denominator").alias("denominator"), v("unique"), v("multiple"), v("unmatched"), F.max("unassessed_count").alias("unassessed_count"))


def umi_sidecar(reads: DataFrame) -> DataFrame:
    """(read_id, umi) of reads that have a UMI, each pair once."""
    return reads.select("read_id", "umi").filter("read_id is not null and umi is not null").distinct()


def scoped(obs: DataFrame, scope: DataFrame, keys: list[str]) -> DataFrame:
    """The observations of the distinct scopes that are asked for."""
    return obs.join(scope.select(*keys).distinct(), keys, "left_semi")


def attach_barcodes(airr: DataFrame, barcodes: DataFrame, key: str = "sequence_id") -> tuple[DataFrame, DataFrame]:
    """(rows with their barcode, ids without any). The map must hold an id once; ids with several are reported, too."""
    one = barcodes.groupBy(key).agg(F.min("barcode").alias("barcode"), F.count(F.lit(1)).alias("_n")).filter("_n = 1").drop("_n")
    return airr.drop("barcode").join(one, key), airr.select(key).distinct().join(one.select(key), key, "left_anti")


def candidate_sets(calls: DataFrame) -> DataFrame:
    """(record_id, segment, candidates): the genes of each ambiguous call, sorted and joined by commas. Equal calls count once."""
    c = calls.filter("assignment = 'ambiguous' and gene <> ''")
    return c.groupBy("record_id", "segment").agg(F.array_join(F.array_sort(F.collect_set("gene")), ",").alias("candidates"))


def candidate_genes(candidates: DataFrame) -> DataFrame:
    """Per group, segment and set of candidate genes its records; an empty table gives none."""
    return candidates.groupBy("group_id", "segment", "candidates").agg(F.count(F.lit(1)).alias("records"))


class Snapshots:
    """Computed tables kept in a folder under a fingerprint of their inputs, for any later session.

    A table is given out only if its mark names the same key and the same receipts of its sources, and its files have the
    sizes they were written with. The folder holds `most_bytes` at most: the tables used least recently go first, but not the
    one just written. A table is written aside and moved in place when it is complete. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, most_bytes: int = 50 * 1024**3):
        self.spark, self.folder, self.most = spark, folder.rstrip("/"), most_bytes
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(folder))

    def _at(self, key: str, name: str = "") -> str:
        return f"{self.folder}/{hashlib.sha256(key.encode()).hexdigest()}{name}"

    def _files(self, place: str) -> dict[str, int]:
        return {f.getPath().getName(): f.getLen() for f in self._fs.listStatus(self._path(place)) if f.getPath().getName().startswith("part-")}

    def load(self, key: str, version: str) -> DataFrame | None:
        """The table of the key, or None where there is none, or it is not as it was written, or its sources have another
        version (see version_of)."""
        place = self._at(key)
        mark = self._path(self._at(key, ".json"))
        if not (self._fs.exists(mark) and self._fs.exists(self._path(place))):
            return None
        m = json.loads(self.spark.read.text(mark.toString(), wholetext=True).first()[0])
        if (m["key"], m["version"], m["files"]) != (key, version, self._files(place)):
            return None
        self._fs.setTimes(mark, int(time.time() * 1000), -1)
        return self.spark.read.schema(m["schema"]).parquet(place)

    def seal(self, key: str, version: str, df: DataFrame) -> DataFrame:
        aside, place, mark = self._at(key, ".part"), self._at(key), self._at(key, ".json")
        df.write.mode("overwrite").parquet(aside)
        schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
        self._fs.delete(self._path(mark), False)
        self._fs.delete(self._path(place), True)
        if not self._fs.rename(self._path(aside), self._path(place)):
            raise ValueError(f"{place} could not be published")
        write_bytes(self.spark, mark, json.dumps({"key": key, "version": version, "files": self._files(place), "schema": schema}).encode())
        self._trim(place)
        return self.load(key, version)

    def _trim(self, keep: str) -> None:
        held = []
        for d in self._fs.listStatus(self._path(self.folder)):
            mark = self._path(d.getPath().toString() + ".json")
            if d.isDirectory() and self._fs.exists(mark):
                held.append((self._fs.getFileStatus(mark).getModificationTime(), sum(self._files(d.getPath().toString()).values()), d.getPath()))
        total = sum(n for _, n, _ in held)
        for _, n, p in sorted(held, key=lambda x: x[0]):
            if total > self.most and p.getName() != keep.rsplit("/", 1)[1]:
                self._fs.delete(self._path(p.toString() + ".json"), False)
                self._fs.delete(p, True)
                total -= n

    def get(self, key: str, version: str, compute: Callable[[], DataFrame]) -> DataFrame:
        """The table kept under the key, or computed and kept."""
        have = self.load(key, version)
        return self.seal(key, version, compute()) if have is None else have


def resume(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that are not done yet."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def resume_at(reads: DataFrame, committed: DataFrame, source: str = "source", ordinal: str = "ordinal") -> tuple[DataFrame, DataFrame]:
    """(kept, to do): the records of each source up to the last committed one, and those after it. committed: (source, records).
    Sources without a commit are to do from the start; a source with fewer records than were committed fails the job."""
    c = committed.groupBy(F.col(source).alias("_cs")).agg(F.max("records").alias("_done"))
    have = reads.groupBy(F.col(source).alias("_hs")).agg(F.max(ordinal).alias("_have"))
    short = c.join(have, F.col("_cs") == F.col("_hs"), "left").select("_cs", F.when(F.col("_done") > F.coalesce("_have", F.lit(0)), F.raise_error(F.concat(F.lit("fewer records than committed: "), F.col("_cs"))).cast("bigint")).otherwise(F.col("_done")).alias("_done"))
    j = reads.join(short, F.col(source) == F.col("_cs"), "left")
    before = F.col(ordinal) <= F.coalesce("_done", F.lit(0))
    return j.filter(before).select(*reads.columns), j.filter(~before).select(*reads.columns)


def batches(df: DataFrame, size: int = 10_000) -> Iterator[list]:
    """The rows in lists of `size`, for a consumer outside Spark; the driver holds a partition at a time."""
    held: list = []
    for row in df.toLocalIterator(prefetchPartitions=False):
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def leases(claims: DataFrame, now: Column, seconds: int = 90) -> DataFrame:
    """(task, owner, heartbeat_at, state): the latest claim of each task; held while its heartbeat is not older than
    `seconds`, else expired. claims: (task, owner, heartbeat_at); claims without a heartbeat are expired."""
    last = claims.groupBy("task").agg(F.max(F.struct("heartbeat_at", "owner")).alias("c"))
    held = F.coalesce(F.col("c.heartbeat_at") >= now - F.make_dt_interval(secs=F.lit(seconds)), F.lit(False))
    return last.select("task", "c.owner", "c.heartbeat_at", F.when(held, "held").otherwise("expired").alias("state"))
