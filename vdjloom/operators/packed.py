"""Problem 6: several values packed in one field, split into one value per row.

Method: dialects are chosen by minimum description length. Every distinct string is parsed in
every delimiter-and-quote dialect that fits it; a parse costs its dialect's bits plus the
code length of each of its values; the cheapest parse is taken. A value's code length is
-log2 of its share among the values of unambiguous fields (a JSON array, or a text without
any delimiter), counted over the whole table; a value not seen there is spelled out, and a
delimiter inside an unquoted value is dear. So a name that holds a delimiter stays whole
wherever the table knows it as a name.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vdjloom.functions.text import BAD_CALLS, is_bad_call, strip

# Delimiters by the bits their dialect costs: common ones are cheap.
DELIMITERS = {
    ",": (r",", 2.0), ";": (r";", 2.0), "|": (r"\|", 3.0), "tab": (r"\t", 3.0),
    "cjk-comma": (r"，", 4.0), "cjk-list": (r"、", 4.0), "cjk-semicolon": (r"；", 4.0),
    "any": (r"[,;|\t，、；]", 5.0), "or": (r"\s+or\s+", 5.0), "slash": (r"\s+/\s+", 5.0),
    "and": (r"\s+and\s+", 7.0), "plus": (r"\s*[+&]\s*", 7.0), "line": (r"[\r\n]+", 4.0), "space": (r"\s+", 7.0),
}
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "「": "」", "`": "`"}
BRACKETS = {"[": "]", "{": "}"}
ESCAPE_BITS, LETTER_BITS, MARK_BITS, BAD_BITS, WRAP_BITS = 4.0, 5.5, 12.0, 3.0, 2.0
_MARKS = re.compile(r"[,;|\t，、；\r\n\"“”「」\[\]{}\\]")
_COMPILED = {k: (re.compile(p), bits) for k, (p, bits) in DELIMITERS.items()}
_BAD = frozenset(BAD_CALLS)

# A field that can only hold one value: no delimiter, quote, bracket or white space inside,
# or a JSON array of one plain string.
SINGLE = r"""^[\s]*(?:[^,;|\s，、；"'“‘「`\[\]{}+&\\]*|\[\s*\]|\[\s*"[^"\\]*"\s*\])[\s]*$"""

Parse = tuple[float, list[tuple[str, bool]]]  # bits without its values, values with "was quoted"


def _json_list(t: str) -> list[str] | None:
    """The strings of a JSON array, also of one that is a JSON string itself, however often; else None.
    Every turn of the loop makes the text shorter."""
    while t and t[0] in '["':
        try:
            x = json.loads(t)
        except (ValueError, RecursionError):
            return None
        if isinstance(x, list):
            out = []
            for v in x:
                out += [v] if isinstance(v, str) else [] if v is None else [json.dumps(v)]
            return out
        if not isinstance(x, str):
            return None
        t = x.strip()
    return None


def _delimited(t: str, delimiter: re.Pattern, quotes: bool) -> list[tuple[str, bool]] | None:
    """The items between delimiters. With quotes, an item may stand in quotes (doubled or
    escaped inside) and a backslash takes the next mark's meaning; None if a quote never closes."""
    if not quotes:
        return [(x.strip(), False) for x in delimiter.split(t)]
    out, i, n = [], 0, len(t)
    while True:
        j = i
        while j < n and t[j].isspace() and not delimiter.match(t, j):
            j += 1
        if j < n and t[j] in QUOTES:
            close, k, buf = QUOTES[t[j]], j + 1, []
            while True:
                if k >= n:
                    return None
                if t[k] == "\\" and k + 1 < n and t[k + 1] in ('"', "'", "\\"):
                    buf.append(t[k + 1])
                    k += 2
                elif t[k] == close:
                    if k + 1 < n and t[k + 1] == close:
                        buf.append(close)
                        k += 2
                    else:
                        break
                else:
                    buf.append(t[k])
                    k += 1
            k += 1
            m = delimiter.match(t, k)
            while k < n and t[k].isspace() and not m:
                k += 1
                m = delimiter.match(t, k)
            if k < n and not m:
                return None
            out.append(("".join(buf).strip(), True))
        else:
            k, buf, m = i, [], None
            while k < n:
                if t[k] == "\\" and k + 1 < n and _MARKS.match(t[k + 1]):
                    buf.append(t[k + 1])
                    k += 2
                    continue
                m = delimiter.match(t, k)
                if m and m.end() > k:
                    break
                m = None
                buf.append(t[k])
                k += 1
            out.append(("".join(buf).strip(), False))
        if k >= n:
            return out
        i = m.end()


def parses(s: str) -> dict[str, Parse]:
    """Every dialect that fits s: its bits and its values (blank and bad-call words dropped). Quotes or brackets around
    the whole are taken off one after the other, as long as there are any."""
    out: dict[str, Parse] = {}
    t, layer = s.strip(), 0
    while True:
        wrapped, wrap = "wrapped " * layer, WRAP_BITS * layer

        def add(name: str, bits: float, items: list[tuple[str, bool]]) -> None:
            good = [x for x in items if x[0].upper() not in _BAD]
            out[wrapped + name] = (wrap + bits + BAD_BITS * (len(items) - len(good)), good)

        listed = _json_list(t)
        if listed is not None:  # says itself where each value ends
            add("json", 1.0, [(x.strip(), True) for x in listed])
            return out
        add("plain", 1.0, [(t, layer > 0)])
        marked = any(c in t for c in QUOTES) or "\\" in t
        for name, (pattern, bits) in _COMPILED.items():
            if pattern.search(t):
                add(name, bits, _delimited(t, pattern, False))
                quoted = _delimited(t, pattern, True) if marked else None
                if quoted is not None:
                    add(name + " quoted", bits + 1, quoted)
        if len(t) < 2:
            return out
        if QUOTES.get(t[0]) == t[-1]:
            body = t[1:-1]
            t = body.replace(t[-1] * 2, t[-1]) if t[-1] * 2 in body else body.replace("\\" + t[-1], t[-1])
        elif BRACKETS.get(t[0]) == t[-1]:
            t = t[1:-1]
        else:
            return out
        t, layer = t.strip(), layer + 1


def spelled(value: str, quoted: bool) -> float:
    """Bits of a value that the table does not know."""
    return ESCAPE_BITS + LETTER_BITS * len(value) + (0.0 if quoted else MARK_BITS * len(_MARKS.findall(value)))


def _candidates(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        rows = []
        for field, s, n in zip(p["field_name"], p["packed"], p["n"]):
            seen = {}
            for name, (bits, items) in parses(s).items():
                key = tuple(v for v, _ in items)
                cost = sum(spelled(v, q) for v, q in items)
                if key not in seen or bits + cost < seen[key][0]:
                    seen[key] = (bits + cost, name, bits, items)
            only = len(seen) == 1
            for _, name, bits, items in seen.values():
                rows.append((field, s, n, name, bits, [v for v, _ in items], [spelled(v, q) for v, q in items], only or name == "json"))
        yield pd.DataFrame(rows, columns=["field_name", "packed", "n", "dialect", "bits", "items", "spelled", "sure"])


_CANDIDATE = "field_name string, packed string, n bigint, dialect string, bits double, items array<string>, spelled array<double>, sure boolean"


def fields_of(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field_name, packed): a row per field that is not null."""
    long = reduce(
        DataFrame.unionByName,
        [df.select(F.col(key), F.lit(f).alias("field_name"), F.col(f).cast("string").alias("packed")) for f in fields],
    ) if len(fields) == 1 else df.select(F.col(key), F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("packed")) for f in fields))).alias("_f")).select(key, "_f.*")
    return long.filter(F.col("packed").isNotNull())


def cheapest_parses(strings: DataFrame, settle) -> DataFrame:
    """(field_name, packed, dialect, items): the cheapest parse of each distinct string.

    strings: (field_name, packed, n), each pair once with its number of rows. Strings that
    can hold one value only (SINGLE) serve as evidence and are not returned.
    settle: writes the candidates and reads them back (they are used three times).
    """
    one = F.regexp_extract("packed", r'^\s*\[\s*"([^"\\]*)"\s*\]\s*$', 1)
    single = F.col("packed").rlike(SINGLE)
    plain = strings.filter(single).select("field_name", "n", strip(F.when(F.col("packed").rlike(r"^\s*\["), one).otherwise(F.col("packed"))).alias("item"))
    found = settle(strings.filter(~single).mapInPandas(_candidates, _CANDIDATE))
    sure = found.filter("sure").select("field_name", "n", F.explode("items").alias("item"))
    seen = plain.filter(~is_bad_call("item")).unionByName(sure).groupBy("field_name", "item").agg(F.sum("n").alias("c"))
    total = seen.groupBy(F.col("field_name").alias("_t")).agg(F.sum("c").alias("_total"))  # a row per field
    code = seen.join(F.broadcast(total), F.col("field_name") == F.col("_t")).select(
        F.col("field_name").alias("_f"), F.col("item").alias("_item"), (1.0 - F.log2(F.col("c") / F.col("_total"))).alias("_code")
    )
    parts = found.filter("not sure").select(
        "field_name", "packed", "dialect", "bits", F.explode_outer(F.arrays_zip("items", "spelled")).alias("_p")
    )
    cost = (
        parts.join(code, (F.col("field_name") == F.col("_f")) & (F.col("_p.items") == F.col("_item")), "left")
        .groupBy("field_name", "packed", "dialect", "bits")
        .agg(F.sum(F.least(F.col("_p.spelled"), F.col("_code")) + 1.0).alias("values_bits"))
    )
    best = cost.groupBy("field_name", "packed").agg(
        F.min(F.struct((F.coalesce("values_bits", F.lit(0.0)) + F.col("bits")).alias("b"), F.col("dialect"))).alias("m")
    ).select(F.col("field_name").alias("_f"), F.col("packed").alias("_s"), F.col("m.dialect").alias("_d"))
    chosen = found.filter("not sure").join(
        best, (F.col("field_name") == F.col("_f")) & (F.col("packed") == F.col("_s")) & (F.col("dialect") == F.col("_d"))
    )
    cols = ["field_name", "packed", "dialect", "items"]
    return found.filter("sure").select(*cols).unionByName(chosen.select(*cols))


def split_packed(df: DataFrame, key: str, fields: list[str], settle, least_items: int = 2) -> DataFrame:
    """(key, field_name, pos, item): a row for every value of each field that holds at least
    least_items (2 or more) values; pos counts from 1.

    Rows that repeat key and field content count once. Null fields, blank values and the words
    that stand for no call give no row and take no position; a value listed twice comes out
    twice. Texts in no list dialect are one value. Tables without rows give none.

    Scale: strings are parsed once each, however many rows hold them (map-side combined
    distinct); rows meet their string's parse in an equi-join that AQE splits where one
    string is hot, or broadcasts where the parses are few.
    """
    long = fields_of(df, key, fields)
    strings = settle(long.groupBy("field_name", "packed").agg(F.count(F.lit(1)).alias("n")))
    several = cheapest_parses(strings, settle).filter(F.size("items") >= least_items)
    p = several.select(F.col("field_name").alias("_f"), F.col("packed").alias("_s"), "items")
    rows = long.filter(~F.col("packed").rlike(SINGLE)).distinct()
    return (
        rows.join(p, (F.col("field_name") == F.col("_f")) & (F.col("packed") == F.col("_s")))
        .select(key, "field_name", F.posexplode("items").alias("_pos", "item"))
        .select(key, "field_name", (F.col("_pos") + 1).alias("pos"), "item")
    )
