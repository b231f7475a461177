"""Explicit schemas of the repertoire tables and the closed vocabularies of their columns."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values.
CHAINS = ("IGH", "IGK", "IGL", "TRA", "TRB", "TRD", "TRG")
MATCH_CLASSES = ("unique", "multiple", "unmatched")
ISOTYPE_ORDER = ("M", "D", "A", "G", "E")
AIRR_STRINGS = (
    "sequence_id", "sequence", "sequence_aa", "cdr3", "cdr3_aa", "junction_aa", "locus", "productive",
    "v_call", "d_call", "j_call", "c_call",
)
AIRR_ALIGNMENTS = tuple(f"{s}_alignment_{e}" for s in "vdjc" for e in ("start", "end"))


_TYPES = {
    "string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
    "array<string>": T.ArrayType(T.StringType()),
}


def _struct(text: str) -> T.StructType:
    """A schema from "name type, ..."; needs no session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split() for f in text.split(","))])


AIRR = _struct(
    ", ".join(f"{c} string" for c in AIRR_STRINGS)
    + ", v_score double, v_identity double, "
    + ", ".join(f"{c} int" for c in AIRR_ALIGNMENTS)
    + ", sequence_alignment string, germline_alignment string, umi_counts bigint"
)
READS = _struct("source string, stage string, ordinal bigint, title string, canonical string, sequence string, quality string")
OBSERVATIONS = _struct(
    "id bigint, sample_key string, sample string, pair string, chain string, scope string, sequence_id string, "
    "match_class string, primers array<string>, families int, filter_reason string, v_call string, j_call string, "
    "c_call string, sequence string, mapping_primers array<string>, trim_state string, trim_length int, "
    "matching_source string, matching_ordinal bigint, matching_unit string, mapping_sequence_id string, sample_match_class string"
)
CLONES = _struct(
    "sample_key string, chain string, rank bigint, v_call string, j_call string, cdr3_aa string, record_count bigint, "
    "frequency_percent double, cumulative_frequency_percent double"
)
GENE_USAGE = _struct(
    "group_id string, primer string, segment string, gene string, unique_count bigint, ambiguous_count bigint, "
    "denominator bigint, percent double, reference_catalog int, status string, metric string, aa_field string"
)
