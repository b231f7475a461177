"""Text and reference-key expressions (columns in, columns out; all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that Unicode knows (what str.strip() removes).
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Words that stand for "no call" (compared trimmed and upper-cased).
BAD_CALLS = ("", "*", "-", "NA", "N/A", "NONE", "NULL", "NO_HIT", "UNMAPPED", "NOT_FOUND")


def strip(col: Column | str) -> Column:
    """Without outer white space; null stays null."""
    return F.trim(F.col(col) if isinstance(col, str) else col, F.lit(WHITE_SPACE))


def blank_to_null(col: Column | str) -> Column:
    """a cell of white space only becomes null, any other is left as it is."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(strip(c) != "", c)


def is_bad_call(col: Column | str) -> Column:
    """True for null and for every word that stands for no call."""
    return F.coalesce(F.upper(strip(col)).isin(*BAD_CALLS), F.lit(True))


def reference_key(col: Column | str) -> Column:
    """The form in which references are compared: a string in lower case without outer
    white space; null where it is blank or a word for no call."""
    c = (F.col(col) if isinstance(col, str) else col).cast("string")
    return F.when(~is_bad_call(c), F.lower(strip(c)))


def value_key(col: Column | str) -> Column:
    """The form in which values are compared: upper case, trimmed; null where blank."""
    c = F.upper(strip(col))
    return F.when(c != "", c)


def pct(num: Column, den: Column) -> Column:
    """100 * num / den as double; null when the denominator is null or zero (N/A is not zero)."""
    return F.when(den != 0, F.lit(100.0) * num.cast("double") / den.cast("double"))


def sql_text(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def sql_list(values) -> str:
    return ", ".join(map(sql_text, values))


def sql_strip(expr: str) -> str:
    """DuckDB text of strip()."""
    chars = " || ".join(f"chr({ord(c)})" for c in WHITE_SPACE)
    return f"trim({expr}, {chars})"


def sql_reference_key(expr: str) -> str:
    """DuckDB text of reference_key()."""
    s = sql_strip(f"cast({expr} as varchar)")
    return f"(case when upper({s}) not in ({sql_list(BAD_CALLS)}) then lower({s}) end)"
