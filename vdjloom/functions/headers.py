"""Read headers, UMIs and read structure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TSO_POSITION = 27  # 1-based start of the template switch oligo in R1
BARCODE_LENGTH, UMI_LENGTH = 16, 10  # droplet reads
BULK_UMI, BULK_BARCODE = 10, 8


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def canonical_header(c: Column | str, short_coordinates: bool = False) -> Column:
    """the key under which a read's headers meet: first word, cut at '#', no /1 or /2,
    seven colon fields at most, the fields from the fourth on without letters and leading zeros.
    With short_coordinates, ids whose second and third field read L01 and R001C001 are cleaned
    from the second field on. A leading '@' or '>' is dropped then, as in FASTA ids."""
    t = _col(c)
    if short_coordinates:
        t = F.regexp_replace(t, r"^[@>]+", "")
    t = F.regexp_replace(F.split(F.split(F.trim(t), r"\s+")[0], "#")[0], r"/[12]$", "")
    f = F.split(t, ":")
    fields = F.when(F.size(f) >= 8, F.slice(f, 1, 7)).otherwise(f)
    short = (F.size(f) < 8) & (F.size(f) >= 3) & F.coalesce(F.get(f, F.lit(1)).rlike(r"(?i)^L\d+$"), F.lit(False)) & F.coalesce(F.get(f, F.lit(2)).rlike(r"(?i)^R\d+C\d+$"), F.lit(False))
    start = F.when(short, 1).otherwise(3) if short_coordinates else F.lit(3)

    def clean(x: Column, i: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(x, "[A-Za-z]", ""), "^0+", "")
        return F.when(i < start, x).when(plain == "", "0").otherwise(plain)

    return F.array_join(F.transform(fields, clean), ":")


def aliases(c: Column | str) -> Column:
    """every form under which an id may be looked up: as it is, first word, before '#', canonical."""
    raw = _col(c)
    token = F.split(F.trim(raw), r"\s+")[0]
    return F.array_distinct(F.array(raw, token, F.split(token, "#")[0], canonical_header(raw)))


def umi(c: Column | str) -> Column:
    """a UMI in upper case without '#UMI:' or '#'; null if it is not made of A, C, G, T, N."""
    u = F.regexp_replace(F.upper(F.trim(_col(c))), r"^#(UMI:)?", "")
    return F.when(u.rlike("^[ACGTN]+$"), u)


def header_umi(c: Column | str) -> Column:
    """the UMI at the end of a header's first word, or null."""
    u = F.regexp_extract(F.upper(F.split(F.trim(_col(c)), r"\s+")[0]), r"#(?:UMI:)?([ACGTN]+)$", 1)
    return F.when(u != "", u)


def barcode_name(c: Column | str) -> Column:
    """BC_007, bc7 and 7 are barcode '7'; null for any other name."""
    n = F.regexp_extract(F.upper(F.trim(_col(c))), r"^(?:BC[_-]?)?0*(\d+)$", 1)
    return F.when(n != "", n)


def reverse_complement(c: Column | str) -> Column:
    return F.reverse(F.translate(F.upper(_col(c)), "ACGTRYKMBVDHN", "TGCAYRMKVBHDN"))


def has_tso_at(c: Column | str, tso: str, position: int = TSO_POSITION) -> Column:
    """the oligo stands exactly at the 1-based position."""
    return F.substring(F.upper(_col(c)), position, len(tso)) == tso.upper()


def barcode_prefix(c: Column | str, barcode: str, lead: int = 3, reverse: bool = False) -> Column:
    """any `lead` bases, then the barcode (or its reverse complement) at the read's start."""
    b = F.lit(barcode.upper())
    return F.substring(F.upper(_col(c)), lead + 1, len(barcode)) == (reverse_complement(b) if reverse else b)


def tso_parts(c: Column | str, tso: str, position: int | None = TSO_POSITION) -> Column:
    """struct(tso_at, barcode, umi, insert): the bases before and after the oligo. tso_at is 0
    where it is missing or too near the start; the parts are null then. position None: anywhere."""
    s = F.upper(_col(c))
    found = F.instr(s, tso.upper())
    at = found if position is None else F.when(F.substring(s, position, len(tso)) == tso.upper(), position).otherwise(0)
    need = BARCODE_LENGTH + UMI_LENGTH
    ok = at > need
    return F.struct(
        F.when(ok, at).otherwise(0).alias("tso_at"),
        F.when(ok, F.substring(s, 1, BARCODE_LENGTH)).alias("barcode"),
        F.when(ok, F.substring(s, BARCODE_LENGTH + 1, UMI_LENGTH)).alias("umi"),
        F.when(ok, s.substr(at + len(tso), F.length(s))).alias("insert"),
    )


def bulk_parts(c: Column | str, barcode: Column) -> Column:
    """struct(umi, state, insert) of a bulk read: 10 bases UMI, then the sample's 8-base barcode.
    state: match, mismatch, or short (which counts as a mismatch, too)."""
    s = F.upper(_col(c))
    n = BULK_UMI + BULK_BARCODE
    state = F.when(F.length(s) < n, "short").when(F.substring(s, BULK_UMI + 1, BULK_BARCODE) == F.upper(barcode), "match").otherwise("mismatch")
    ok = state == "match"
    return F.struct(F.when(ok, F.substring(s, 1, BULK_UMI)).alias("umi"), state.alias("state"), F.when(ok, s.substr(F.lit(n + 1), F.length(s))).alias("insert"))


def quality(c: Column | str) -> Column:
    """struct(mean_quality, expected_errors) of a Phred+33 string; nulls for null or ''."""
    q = F.transform(F.filter(F.split(_col(c), ""), lambda x: x != ""), lambda x: (F.ascii(x) - 33).cast("double"))
    n = F.size(q)
    total = F.aggregate(q, F.lit(0.0), lambda a, x: a + x)
    errors = F.aggregate(q, F.lit(0.0), lambda a, x: a + F.pow(F.lit(10.0), -x / 10))
    return F.struct(F.when(n > 0, total / n).alias("mean_quality"), F.when(n > 0, errors).alias("expected_errors"))


def slug(c: Column | str) -> Column:
    """a name that is safe in paths, with 12 hex digits of its hash so that it stays unique."""
    s = _col(c)
    return F.concat(F.regexp_replace(s, r"[^A-Za-z0-9._-]+", "_"), F.lit("_"), F.substring(F.sha2(s, 256), 1, 12))
