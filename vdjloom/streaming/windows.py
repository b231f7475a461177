"""Event windows and incremental completion (extension; T02, T03, T05)."""

from __future__ import annotations

import csv
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(events: DataFrame, size: str = "1 hour", late: str | None = None) -> DataFrame:
    """Events and their value per window and type, for a batch or a stream (late: the watermark)."""
    e = events.withWatermark("ts", late) if late else events
    g = e.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value_sum"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "events", "value_sum")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """A user's events that follow each other within the gap, as one session."""
    e = events.withWatermark("ts", late) if late else events
    g = e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("events"))
    return g.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def follow(spark: SparkSession, path: str, schema, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame]):
    """Everything that is new in a growing folder of Parquet files since the last call, transformed and appended to
    the target; the checkpoint remembers what was read, so a broken call is taken up where it stopped."""
    s = transform(spark.readStream.schema(schema).parquet(path))
    return s.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def complete_samples(done: DataFrame, expected: DataFrame) -> DataFrame:
    """Samples all of whose expected chains are done. done, expected: (sample, chain)."""
    missing = expected.select("sample", "chain").distinct().join(done.select("sample", "chain").distinct(), ["sample", "chain"], "left_anti")
    return expected.select("sample").distinct().join(missing.select("sample").distinct(), "sample", "left_anti")


def stale(inputs: DataFrame, finished: DataFrame) -> DataFrame:
    """(sample, fingerprint) whose inputs differ from those of the last finished run: the ones to compute again.
    inputs: (sample, path, size, modified); finished: (sample, fingerprint). The fingerprint is a hash of the
    sample's sorted file receipts."""
    one = F.concat_ws("|", "path", F.col("size").cast("string"), F.col("modified").cast("string"))
    now = inputs.groupBy("sample").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(one)), "\n"), 256).alias("fingerprint"))
    return now.join(finished.select("sample", "fingerprint"), ["sample", "fingerprint"], "left_anti")


def observe(spark: SparkSession, path: str, state: dict | None = None, expected: int | None = None, now: float | None = None, chunk: int = 1024 * 1024, required: str = "sequence_id", sep: str = "\t") -> dict:
    """What is new in a growing delimited file since `state`: reads on from its offset, counts the complete rows, and
    keeps an unfinished line for the next call. The driver holds `chunk` bytes and that line.

    The new state: offset, pending, columns, rows (null until the header is there), status (observed, catching_up while more is
    waiting, unavailable) and eta, the seconds that may be left: (low, high), from the pace of the calls. unavailable: the file is gone or has
    shrunk, its header lacks `required`, a row has another number of fields, or there are more rows than expected.
    """
    s = dict(state or {"offset": 0, "pending": b"", "columns": None, "rows": 0, "pace": []})
    s["eta"] = None
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    size = fs.getFileStatus(p).getLen() if fs.exists(p) else -1
    if s.get("status") == "unavailable" or size < s["offset"] and s["offset"]:
        return s | {"status": "unavailable"}
    if size > s["offset"]:
        f = fs.open(p)
        try:
            f.seek(s["offset"])
            n = min(chunk, size - s["offset"])
            new = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(f, n))
        finally:
            f.close()
        *lines, s["pending"] = (s["pending"] + new).split(b"\n")
        s["offset"] += n
        for line in lines:
            fields = next(csv.reader([line.decode("utf-8", "replace").rstrip("\r")], delimiter=sep), [])
            if s["columns"] is None:
                if required not in fields:
                    return s | {"status": "unavailable"}
                s["columns"] = len(fields)
            elif len(fields) != s["columns"]:
                return s | {"status": "unavailable"}
            else:
                s["rows"] += 1
    if expected is not None and s["rows"] > expected:
        return s | {"status": "unavailable"}
    s["status"] = "catching_up" if size > s["offset"] else "observed"
    if s["status"] == "observed" and s["columns"] is not None and expected:
        s["pace"] = [*s["pace"], (time.monotonic() if now is None else now, s["rows"])][-40:]
        s["eta"] = _eta(s["pace"], expected)
    elif s["status"] != "observed":
        s["pace"] = []
    return s


def _eta(pace: list[tuple[float, int]], expected: int) -> tuple[int, int] | None:
    """Seconds left at the fastest and the slowest of two paces (the first and the second half of the calls); none before four
    calls, 20 seconds and 50 rows, or where the paces differ more than four times."""
    if len(pace) < 4 or pace[-1][0] - pace[0][0] < 20 or pace[-1][1] - pace[0][1] < 50 or pace[-1][1] >= expected:
        return None
    mid = pace[len(pace) // 2]
    speeds = [(b[1] - a[1]) / (b[0] - a[0]) for a, b in ((pace[0], mid), (mid, pace[-1])) if b[0] > a[0]]
    if len(speeds) < 2 or min(speeds) <= 0 or max(speeds) > 4 * min(speeds):
        return None
    left = expected - pace[-1][1]
    return int(left / max(speeds)), int(left / min(speeds))
