"""Checked values: copies, times, Unicode forms, sequences."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from vdjloom.functions.calls import AMINO_ACIDS, count
from vdjloom.functions.text import strip

# The letters of each kind of sequence.
ALPHABETS = {"iupac": "ACGTRYSWKMBDHVNU", "acgt": "ACGT", "acgtn": "ACGTN", "aa": AMINO_ACIDS}


def copy_count(copy: str = "copy", umi_counts: str = "umi_counts") -> Column:
    """the copies of a row from one or both of its count columns, which must be positive whole numbers and
    agree; anything else fails the job. A null or blank column counts as not there; both missing fail, too."""
    a, b = (F.when(strip(F.col(c).cast("string")) != "", F.coalesce(count(c), F.lit(-1))) for c in (copy, umi_counts))
    n = F.coalesce(a, b)
    ok = (n > 0) & (F.coalesce(a, n) == F.coalesce(b, n))
    return F.when(F.coalesce(ok, F.lit(False)), n).otherwise(F.raise_error(F.lit("copy and umi_counts must be positive whole numbers and agree")).cast("bigint"))


def nfkc(c: Column | str) -> Column:
    """Compatibility form of Unicode text (Spark has no expression for it); null stays null."""

    def normal(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield p.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))

    normal.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(normal, "string")(F.col(c) if isinstance(c, str) else c)


def utc_time(c: Column | str) -> Column:
    """A time without zone, in UTC, from an ISO text with T or a blank, with offset, Z or neither (then it is UTC);
    null for anything else."""
    t = strip(c)
    zoned = F.when(t.rlike(r"(Z|[+-]\d\d:?\d\d)$"), t).otherwise(F.concat(t, F.lit("Z")))
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.try_to_timestamp(zoned).cast("timestamp_ntz"))


def within_days(c: Column, now: Column, days: int) -> Column:
    """The time lies no more than `days` days before now."""
    return c >= now - F.make_dt_interval(F.lit(days))


def valid_sequence(c: Column | str, kind: str = "iupac") -> Column:
    """Only letters of the alphabet (iupac, acgt, acgtn, aa), in either case; false for null and ''."""
    return F.coalesce(F.upper(F.col(c) if isinstance(c, str) else c).rlike(f"^[{ALPHABETS[kind]}]+$"), F.lit(False))
