"""Primer matching and its summaries.

A primer is a sequence of IUPAC codes that must stand at the start of a read. Instead of
testing every read against every primer's pattern (a nested-loop join), primers are written
out into the concrete prefixes they accept, with all primers of a prefix in one row. Reads look their start up
in these tables, one per prefix length, where they are: each look-up finds one row at most, so reads are neither
moved nor multiplied. Primers with too many prefixes keep their first codes as key and test the whole pattern afterwards.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vdjloom.functions.text import pct
from vdjloom.schemas import CHAINS, MATCH_CLASSES

# The bases each IUPAC code stands for, and the adapter before the UMI.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
ADAPTER = "ACACTCTTTCCCTACACGACGCTCTTCCGATCT"
UMI_LENGTH, BARCODE_LENGTH = 10, 8
MAX_PREFIXES = 4096  # concrete prefixes per primer
MAX_TABLE = 200_000  # concrete prefixes of all primers together: what is broadcast
RETAINED = ("retained", "retained_history", "imported_result")


def pattern(sequence: str) -> str:
    """The regular expression a primer accepts; a read's N matches none of it."""
    return "^" + "".join(f"[{IUPAC[b]}]" for b in sequence.upper())


def prefixes(sequence: str, most: int = MAX_PREFIXES) -> tuple[int, list[str]]:
    """(length, concrete prefixes): of the whole primer, or of as many of its first codes as `most` allows."""
    n, total = 0, 1
    for b in sequence.upper():
        if total * len(IUPAC[b]) > most:
            break
        total *= len(IUPAC[b])
        n += 1
    return n, ["".join(x) for x in product(*(IUPAC[b] for b in sequence.upper()[:n]))]


def catalogue(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(sample, chain, grp, name, sequence) from checked rows; sample or chain None: any.
    Raises on blank names, codes that are not IUPAC, and a name with two sequences."""
    seen: dict[str, str] = {}
    for _, _, _, name, seq in rows:
        if not name or not seq or any(b not in IUPAC for b in seq.upper()):
            raise ValueError(f"primer {name!r}: no name or not IUPAC: {seq!r}")
        if seen.setdefault(name, seq.upper()) != seq.upper():
            raise ValueError(f"primer {name!r} has two sequences")
    return spark.createDataFrame([(a, b, g, n, s.upper()) for a, b, g, n, s in rows], "sample string, chain string, grp string, name string, sequence string")


def strip_structure(sequence: str, adapter: str = ADAPTER, umi: int = UMI_LENGTH, barcode: int = BARCODE_LENGTH) -> str:
    """An oligo as ordered (adapter, N for the UMI, barcode, primer) without what stands before the primer.
    Raises where that structure is missing."""
    s = "".join(sequence.split()).upper()
    prefix = adapter.upper() + "N" * umi
    if not s.startswith(prefix) or len(s) <= len(prefix) + barcode:
        raise ValueError(f"oligo {sequence!r} is not adapter, UMI, barcode and primer")
    return s[len(prefix) + barcode :]


def build_catalogue(
    spark: SparkSession, sheet: list[tuple], selected: list[tuple], samples: list[str], aliases: dict[str, str] | None = None,
    sample_chains: dict[str, list[str]] | None = None, separator: str = "", by_name: bool = False, oligo: bool = True,
) -> DataFrame:
    """The catalogue() of the given samples, from a primer sheet and the groups chosen for each sample.

    sheet: (group, name, sequence), of which rows without name and sequence are passed over; selected: (sample, chain
    or None, groups), the groups of a cell split at `separator`; aliases: a sample's name in `selected`. by_name:
    a group that the sheet lacks is looked up as a primer's name. oligo: sequences are oligos, see strip_structure().
    Raises on incomplete sheet rows, groups that are not found, rows with groups but no sample, samples without
    any group, and chains of sample_chains without one where the sample's groups are chosen by chain.
    """
    rows = []
    for row in sheet:
        group, name, full = (str(x or "").strip() for x in row)
        if not name and not full:
            continue
        if not group or not name or not full:
            raise ValueError(f"primer sheet: no group, name or sequence in {row!r}")
        rows.append((group, name, strip_structure(full) if oligo else "".join(full.split()).upper()))
    catalogue(spark, [(None, None, *x) for x in rows])  # the whole sheet is checked
    aliases, sample_chains = aliases or {}, sample_chains or {}
    wanted = {aliases.get(s, s) for s in samples}
    chosen: dict[str, dict[tuple, tuple]] = {}
    for sample, chain, cell in selected:
        sample, cell = str(sample or "").strip(), str(cell or "").strip()
        if not sample and cell:
            raise ValueError(f"groups without a sample: {cell!r}")
        if sample not in wanted or not cell:
            continue
        if chain is not None and chain not in CHAINS:
            raise ValueError(f"sample {sample!r}: unknown chain {chain!r}")
        for g in (x.strip() for x in cell.split(separator)) if separator else [cell]:
            found = [r for r in rows if r[0] == g] or [r for r in rows if by_name and r[1] == g]
            if not found:
                raise ValueError(f"sample {sample!r}: no primer group {g!r}")
            chosen.setdefault(sample, {}).update({(chain, r[1]): r for r in found})
    missing = [s for s in samples if aliases.get(s, s) not in chosen]
    if missing:
        raise ValueError(f"samples without a primer group: {missing[:20]}")
    out = []
    for s in samples:
        own = chosen[aliases.get(s, s)]
        chains = {c for c, _ in own}
        lost = set() if None in chains else set(sample_chains.get(s, [])) - chains
        if lost:
            raise ValueError(f"sample {s!r}: no primer group for {sorted(lost)}")
        out += [(s, c, *own[c, n]) for c, n in sorted(own, key=lambda k: (k[0] or "", k[1]))]
    return catalogue(spark, out)


def window_of(seq: Column, oligo: bool, adapter: str = ADAPTER) -> Column:
    """The part of a read in which primers are looked for: the read, or what follows adapter, UMI
    and barcode; null where that structure is missing."""
    if not oligo:
        return F.upper(seq)
    cut = len(adapter) + UMI_LENGTH + BARCODE_LENGTH
    return F.when(F.startswith(F.upper(seq), F.lit(adapter)) & (F.length(seq) > cut), F.upper(seq).substr(F.lit(cut + 1), F.length(seq)))


def with_match(reads: DataFrame, window: str, primers: list[tuple[str, str, str]]) -> DataFrame:
    """Reads with names and families, the distinct names and sequences, sorted, of the primers that the window starts with.

    primers: (name, sequence, group), of which the driver writes out MAX_TABLE short strings at most; more primers
    than that raise. No read is moved; rows, also repeated ones, and their other columns stay as they are.
    """
    if len(primers) > MAX_TABLE:
        raise ValueError(f"more than {MAX_TABLE} primers")
    most = min(MAX_PREFIXES, max(1, MAX_TABLE // max(1, len(primers))))
    tables: dict[int, dict[str, set]] = {}
    for name, seq, _ in primers:
        n, concrete = prefixes(seq, most)
        rest = None if n == len(seq) else pattern(seq)
        for p in concrete:
            tables.setdefault(n, {}).setdefault(p, set()).add((name, seq.upper(), rest))
    out, found = reads, []
    kind = "array<struct<name: string, family: string, rest: string>>"
    for n, rows in sorted(tables.items()):
        t = reads.sparkSession.createDataFrame([(p, sorted(hits, key=str)) for p, hits in rows.items()], f"__p{n} string, __hits{n} {kind}")
        out = out.join(F.broadcast(t), F.substring(window, 1, n) == F.col(f"__p{n}"), "left")
        hits = F.coalesce(F.col(f"__hits{n}"), F.array().cast(kind))
        if any(rest for hits_ in rows.values() for _, _, rest in hits_):
            hits = F.filter(hits, lambda h: h["rest"].isNull() | F.rlike(F.col(window), h["rest"]))
        found.append(hits)
    all_ = F.concat(*found) if found else F.array().cast(kind)
    of = lambda f: F.array_sort(F.array_distinct(F.transform(F.col("__all"), lambda h: h[f])))
    keep = [F.col(f"`{c}`") for c in reads.columns]
    return out.select(*keep, all_.alias("__all")).select(*keep, of("name").alias("names"), of("family").alias("families"))


def match(reads: DataFrame, key: str, window: str, primers: list[tuple[str, str, str]]) -> DataFrame:
    """(key, names, families) of the reads that start with any primer. See with_match()."""
    return with_match(reads.select(F.col(key), F.col(window).alias("__w")), "__w", primers).filter(F.size("names") > 0).drop("__w")


def categorise(reads: DataFrame, seq: str, primers: list[tuple[str, str, str]], oligo: bool = False) -> DataFrame:
    """Reads with names, families, match_class, trim_state and trim_length.

    match_class: not_configured (no primers), sequence_unavailable (null or ''),
    read_structure_unavailable, unique, multiple, unmatched. The trim state tells what would be
    cut: matched sequences of several lengths are never cut, nor is a read that is primer only.
    """
    prefix = len(ADAPTER) + UMI_LENGTH + BARCODE_LENGTH if oligo else 0
    j = with_match(reads.withColumn("_win", window_of(F.col(seq), oligo)), "_win", primers)
    n = F.size("names")
    cls = (
        F.when(F.lit(not primers), "not_configured").when(F.coalesce(F.length(seq), F.lit(0)) == 0, "sequence_unavailable")
        .when(F.col("_win").isNull(), "read_structure_unavailable").when(n == 1, "unique").when(n > 1, "multiple").otherwise("unmatched")
    )
    lengths = F.array_distinct(F.transform("families", F.length))
    cut = F.lit(prefix) + F.element_at(lengths, 1)
    state = (
        F.when(F.col("_win").isNull(), "structure_untrimmed").when(F.size(lengths) > 1, "ambiguous_length_untrimmed").when(F.size(lengths) == 0, "unmatched_untrimmed")
        .when(cut >= F.length(seq), "primer_only_untrimmed").when(n == 1, "trimmed_unique").otherwise("trimmed_multi_same_length")
    )
    j = j.withColumn("match_class", cls).withColumn("trim_state", state)
    return j.withColumn("trim_length", F.when(F.startswith("trim_state", F.lit("trimmed")), cut).otherwise(0)).drop("_win")


def match_summary(counts: DataFrame, groups: list[str]) -> DataFrame:
    """Per group a row for each of unique, multiple and unmatched with its count, the assessable
    rows as denominator, the percentage and the unassessed rows. counts: (*groups, match_class, n)."""
    total = F.sum("n").alias("_all")
    g = counts.groupBy(*groups).agg(total, *(F.coalesce(F.sum(F.when(F.col("match_class") == c, F.col("n"))), F.lit(0)).alias(c) for c in MATCH_CLASSES))
    den = F.col("unique") + F.col("multiple") + F.col("unmatched")
    rows = g.withColumn("denominator", den).withColumn("unassessed_count", F.col("_all") - den)
    pairs = ", ".join(f"'{c}', `{c}`" for c in MATCH_CLASSES)
    s = rows.select(*groups, "denominator", "unassessed_count", F.expr(f"stack(3, {pairs}) as (match_class, count)"))
    return s.withColumn("percent", pct(F.col("count"), F.col("denominator")))


def by_class(rows: DataFrame, groups: list[str], cls: str = "match_class") -> DataFrame:
    return rows.groupBy(*groups, F.col(cls).alias("match_class")).agg(F.count(F.lit(1)).alias("n"))


def settings(threshold: float, enabled: bool = True) -> float:
    """The review threshold, checked."""
    if not isinstance(enabled, bool):
        raise ValueError("enabled must be a boolean")
    t = float(threshold)
    if not 0 <= t <= 100:
        raise ValueError("threshold must be a finite number from 0 to 100")
    return t


def _names_by_group(primers: list[tuple[str, str, str]]) -> dict[str, list[str]]:
    return {g: sorted({n for n, _, x in primers if x == g}) for g in sorted({p[2] for p in primers})}


def alternative_groups(reads: DataFrame, seq: str, groups: list[str], primers: list[tuple[str, str, str]], assigned: str, summary: DataFrame, threshold: float = 50.0) -> DataFrame:
    """P10: for groups of reads whose unique percentage is below the threshold, how each other primer
    group would do: per read one primer of that group is unique, several are multiple.

    summary: match_summary() over the same groups. `suspected` needs a percentage of at least the
    threshold and above the original one. One pass matches all primers; a read's hits are counted by primer group
    where it is, and only counts are moved.
    """
    t = settings(threshold)
    low = summary.filter((F.col("match_class") == "unique") & (F.col("percent") < t)).select(*(F.col(g).alias(f"__{g}") for g in groups), F.col("denominator"), F.col("percent").alias("original_unique_percent"))
    other = [p for p in primers if p[2] != assigned]
    of = _names_by_group(other)
    m = with_match(reads.filter(F.length(seq) > 0).select(*groups, F.upper(seq).alias("_win")), "_win", other)
    hits = F.array(*(F.struct(F.lit(g).alias("tested_group"), F.size(F.array_intersect("names", F.array(*(F.lit(n) for n in names)))).alias("hits")) for g, names in of.items())) if of else F.array().cast("array<struct<tested_group: string, hits: int>>")
    hit = m.select(*groups, F.explode(F.filter(hits, lambda h: h["hits"] > 0)).alias("_h")).groupBy(*groups, F.col("_h.tested_group").alias("tested_group")).agg(
        F.sum(F.when(F.col("_h.hits") == 1, 1).otherwise(0)).alias("u"), F.sum(F.when(F.col("_h.hits") > 1, 1).otherwise(0)).alias("m")
    )
    tested = low.select("*", F.explode(F.array(*(F.lit(g) for g in of))).alias("_tg")) if of else low.withColumn("_tg", F.lit("")).limit(0)
    same = F.col("tested_group") == F.col("_tg")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"__{g}"))
    j = tested.join(hit, same, "left")
    u, mult = F.coalesce("u", F.lit(0)), F.coalesce("m", F.lit(0))
    p = pct(u, F.col("denominator"))
    status = F.when((p >= t) & (p > F.col("original_unique_percent")), "suspected").otherwise("below_threshold")
    return j.select(
        *(F.col(f"__{g}").alias(g) for g in groups), F.col("_tg").alias("tested_group"), "denominator", "original_unique_percent", u.alias("unique_count"), mult.alias("multiple_count"),
        (F.col("denominator") - u - mult).alias("unmatched_count"), p.alias("unique_percent"), status.alias("status"),
    )


def precheck(summary: DataFrame, groups: list[str], threshold: float = 50.0) -> DataFrame:
    """Per group unavailable (no assessable reads), review (any unassessed read), low or ok."""
    t = settings(threshold)
    u = summary.filter("match_class = 'unique'")
    status = F.when(F.col("denominator") == 0, "unavailable").when(F.col("unassessed_count") > 0, "review").when(F.col("percent") < t, "low").otherwise("ok")
    return u.select(*groups, F.when(F.col("denominator") > 0, F.col("denominator")).alias("total_reads"), F.col("percent").alias("unique_percent"), "unassessed_count", status.alias("status"))


def restrict(names: Column, allowed: Column) -> Column:
    """Matched names cut down to the primers a chain may have."""
    return F.array_sort(F.array_intersect(names, allowed))


def mapping_rates(obs: DataFrame, groups: list[str]) -> DataFrame:
    """Per group and primer bucket the matched, mapped, retained and unverified rows, match percent
    over all rows of the group, and mapping percent, which is null where any row is unverified.

    obs: needs names (array), match_class, v_call, locus_ok (the row's locus is the chain's), filter_reason.
    Buckets: the primer's name if unique, else [Multiple], [Unmatched] or [Unassessed].
    """
    from vdjloom.functions.text import is_bad_call

    bucket = F.when(F.col("match_class") == "unique", F.element_at("names", 1)).when(F.col("match_class") == "multiple", "[Multiple]").when(F.col("match_class") == "unmatched", "[Unmatched]").otherwise("[Unassessed]")
    unsure = F.col("filter_reason").isin("ambiguous_lineage", "pair_identity_unverified", "duplicate_airr_rows", "fastp_membership_unavailable", "clean_membership_unavailable")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    g = obs.groupBy(*groups, bucket.alias("primer")).agg(
        F.count(F.lit(1)).alias("matched_reads"), n(~is_bad_call("v_call") & F.col("locus_ok")).alias("mapped_reads"),
        n(F.col("filter_reason").isin(*RETAINED)).alias("retained_reads"), n(unsure).alias("unverified_reads"),
    )
    total = F.sum("matched_reads").over(Window.partitionBy(*groups))
    return g.withColumn("total_reads", total).withColumn("match_percent", pct(F.col("matched_reads"), F.col("total_reads"))).withColumn(
        "mapping_percent", F.when(F.col("unverified_reads") == 0, pct(F.col("mapped_reads"), F.col("matched_reads")))
    )


def scenarios(reads: DataFrame, seq: str, primers: list[tuple[str, str, str]], suspected: DataFrame, groups: list[str]) -> DataFrame:
    """Reads of groups with a suspected alternative, reclassified under that primer group: a
    row per read and scenario, with scenario_id (a hash of group and tested primer group), names and
    match_class. usage.scenario_lineage() and scenario_records() give copies and gene usage by scenario_id."""
    tested = suspected.filter("status = 'suspected'").select(*(F.col(g).alias(f"__{g}") for g in groups), "tested_group")
    same = F.lit(True)
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"__{g}"))
    sid = F.substring(F.sha2(F.concat_ws("\x00", *(F.col(g).cast("string") for g in groups), F.col("tested_group")), 256), 1, 16)
    m = with_match(reads.withColumn("_win", F.upper(seq)), "_win", primers).drop("_win", "families")
    j = m.join(tested, same).withColumn("scenario_id", sid).drop(*(f"__{g}" for g in groups))
    allowed = F.array().cast("array<string>")
    for g, names in _names_by_group(primers).items():
        allowed = F.when(F.col("tested_group") == g, F.array(*(F.lit(n) for n in names))).otherwise(allowed)
    j = j.withColumn("names", restrict(F.col("names"), allowed))
    n = F.size("names")
    cls = F.when(F.coalesce(F.length(seq), F.lit(0)) == 0, "sequence_unavailable").when(n == 1, "unique").when(n > 1, "multiple").otherwise("unmatched")
    return j.withColumn("match_class", cls)
