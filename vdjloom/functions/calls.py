"""Gene calls, isotypes and amino acids (F12-F21): column expressions without any UDF."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from vdjloom.functions.text import BAD_CALLS, WHITE_SPACE, strip

# Fixed values.
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
ISOTYPE = r"^IGH([MDAGE])([0-9]+(-[0-9]+)?)?$"
FAMILY_C = r"^(IGH[AMDEG]|IGKC|IGLC|TR[ABDG]C)"
FAMILY_V = r"^((?:IGH|IGK|IGL|TRA|TRB|TRD|TRG)V[0-9]+)"
FAMILY_J = r"^((?:IGH|IGK|IGL|TRA|TRB|TRD|TRG)J[0-9]+)-"
FAMILY_J_ANY = r"^((?:IGH|IGK|IGL|TRA|TRB|TRD|TRG)J)"
AA_PLACEHOLDERS = ("", "nan", "na", "none", "null")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _names(c: Column, separators: str, upper: bool = False) -> Column:
    """The genes of a list cut at any of the separator characters. Most calls name one gene: those
    stay within generated code, only real lists go through the array functions."""
    one = strip(c)
    bad = lambda x: F.upper(x).isin(*BAD_CALLS)
    case = F.upper if upper else lambda x: x
    gene = lambda x: case(F.substring_index(x, "*", 1))
    alone = F.lit(True)
    for mark in separators:
        alone = alone & (F.instr(c, mark) == 0)
    items = F.transform(F.split(c, f"[{separators}]"), strip)
    several = F.array_sort(F.array_distinct(F.transform(F.filter(items, lambda x: ~bad(x)), gene)))
    single = F.when(bad(one), F.array().cast("array<string>")).otherwise(F.array(gene(one)))
    return F.when(alone, single).otherwise(several)


def calls(c: Column | str) -> Column:
    """the distinct genes of a call list, sorted, without alleles; empty array for none or null."""
    return F.coalesce(_names(_col(c), ",;"), F.array().cast("array<string>"))


def assignment(genes: Column) -> Column:
    """unique, ambiguous or unannotated, from the array that calls() gives."""
    n = F.size(genes)
    return F.when(n == 1, "unique").when(n > 1, "ambiguous").otherwise("unannotated")


def unique_gene(c: Column | str) -> Column:
    """the gene if the call resolves to exactly one, else null."""
    g = calls(c)
    return F.when(F.size(g) == 1, F.element_at(g, 1))


def normal_gene(c: Column | str) -> Column:
    """upper-case genes joined by a bar; '' for none or null."""
    g = _names(_col(c), ",;|", upper=True)
    return F.coalesce(F.array_join(g, "|"), F.lit(""))


def normal_nt(c: Column | str) -> Column:
    """upper-case nucleotides without white space, '-' and '.'; '' for null."""
    return F.coalesce(F.translate(F.upper(_col(c)), " \t\n\x0b\f\r.-", ""), F.lit(""))


def isotype(c: Column | str) -> Column:
    """F16: struct(main, subtype, state) of a constant-gene call. One gene that is no IGH
    constant gene makes the call unclassified; several main classes make it ambiguous."""
    g = F.transform(calls(c), F.upper)
    main = F.array_distinct(F.transform(g, lambda x: F.concat(F.lit("Ig"), F.regexp_extract(x, ISOTYPE, 1))))
    sub = F.array_distinct(F.transform(g, lambda x: F.concat(F.lit("Ig"), F.regexp_extract(x, ISOTYPE, 1), F.regexp_extract(x, ISOTYPE, 2))))
    odd = F.exists(g, lambda x: ~x.rlike(ISOTYPE))
    one = F.size(main) == 1
    state = F.when(F.size(g) == 0, "unannotated").when(odd, "unclassified").when(one, "classified").otherwise("ambiguous")
    sure = (F.size(g) > 0) & ~odd & one
    return F.struct(
        F.when(sure, F.element_at(main, 1)).otherwise("").alias("main"),
        F.when(sure & (F.size(sub) == 1), F.element_at(sub, 1)).otherwise("").alias("subtype"),
        state.alias("state"),
    )


def gene_family(gene: Column | str, segment: Column | str) -> Column:
    """the family a gene is shown under; a name no rule knows is its own family."""
    name, s = F.split(F.upper(F.coalesce(_col(gene), F.lit(""))), r"\*")[0], _col(segment)
    of = lambda p: F.regexp_extract(name, p, 1)
    found = (
        F.when(s == "C", of(FAMILY_C)).when(s == "V", of(FAMILY_V))
        .when((s == "J") & (of(FAMILY_J) != ""), of(FAMILY_J)).when(s == "J", of(FAMILY_J_ANY)).otherwise("")
    )
    return F.when(found != "", found).otherwise(name)


def natural_order(c: Column | str) -> Column:
    """a sort key in which runs of digits compare as numbers (padded to 12)."""
    name = F.upper(F.coalesce(_col(c), F.lit("")))
    digits, rest = F.regexp_extract_all(name, F.lit(r"(\d+)")), F.split(name, r"\d+")
    # the texts between the runs: one more than there are runs
    return F.array_join(
        F.transform(rest, lambda x, i: F.concat(x, F.when(i < F.size(digits), F.lpad(F.get(digits, i), F.greatest(F.lit(12), F.length(F.get(digits, i))), "0")).otherwise(""))), ""
    )


def aa_valid(c: Column | str) -> Column:
    """only amino-acid letters, trimmed and upper-cased; false for null."""
    return F.coalesce(F.upper(strip(_col(c))).rlike(f"^[{AMINO_ACIDS}]+$"), F.lit(False))


def isotype_label(gene: Column | str) -> Column:
    """IGHG1 -> IgG1; other names as they are."""
    g = _col(gene)
    return F.when(g.startswith("IGH"), F.concat(F.lit("Ig"), F.substring(g, 4, 1000))).otherwise(g)


def isotype_rank(gene: str) -> Column:
    """M, D, A, G, E as 0 to 4, other genes 5; ties are for natural_order."""
    return F.expr(f"coalesce(nullif(instr('MDAGE', nullif(substr(upper({gene}), 4, 1), '')), 0) - 1, 5)")


def number(c: Column | str) -> Column:
    """a finite double or null."""
    d = F.expr("try_cast({} as double)".format(c)) if isinstance(c, str) else c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def count(c: str) -> Column:
    """a non-negative whole number as bigint, or null (1.0 counts as 1)."""
    d = F.expr(f"try_cast({c} as decimal(38,6))")
    return F.when((d >= 0) & (d == F.floor(d)), F.expr(f"try_cast(try_cast({c} as decimal(38,6)) as bigint)"))


# --- names for SQL ----------------------------------------------------------------------------

def register_functions(spark: SparkSession) -> list[str]:
    """gene_order(name), gene_family(gene, segment) and gene_has(call, gene) as functions of the session's SQL. They are SQL
    themselves, so the optimizer sees through them; they give what natural_order(), gene_family() and calls() give."""
    q = lambda s: "r'" + s + "'"
    name = r"split(upper(coalesce(gene, '')), r'\*')[0]"
    family = f"""case segment when 'C' then regexp_extract({name}, {q(FAMILY_C)}, 1) when 'V' then regexp_extract({name}, {q(FAMILY_V)}, 1)
      when 'J' then coalesce(nullif(regexp_extract({name}, {q(FAMILY_J)}, 1), ''), regexp_extract({name}, {q(FAMILY_J_ANY)}, 1)) else '' end"""
    bad = ", ".join(f"'{b}'" for b in BAD_CALLS)
    white = "".join(f"\\u{ord(c):04x}" for c in WHITE_SPACE)
    bodies = {
        "gene_order(name string) returns string": r"""array_join(transform(regexp_extract_all(upper(coalesce(name, '')), r'(\d+|\D+)'), x -> case when x rlike r'^\d' and length(x) < 12 then lpad(x, 12, '0') else x end), '')""",
        "gene_family(gene string, segment string) returns string": f"coalesce(nullif({family}, ''), {name})",
        "gene_has(call string, gene string) returns boolean": f"""coalesce(array_contains(transform(filter(transform(split(call, '[,;]'), x -> trim(both '{white}' from x)), x -> upper(x) not in ({bad})), x -> substring_index(x, '*', 1)), gene), false)""",
    }
    for head, body in bodies.items():
        spark.sql(f"create or replace temporary function {head} return {body}")
    return [h.split("(")[0] for h in bodies]


# --- the same in DuckDB's SQL, for the checks -------------------------------------------------

def sql_names(expr: str, separators: str = "[,;]") -> str:
    bad = ", ".join(f"'{b}'" for b in BAD_CALLS)
    return (
        f"list_sort(list_distinct(list_transform(list_filter(list_transform(string_split_regex({expr}, '{separators}'), lambda x: trim(x)), "
        f"lambda x: upper(x) not in ({bad})), lambda x: string_split(x, '*')[1])))"
    )


def sql_calls(expr: str) -> str:
    return f"coalesce({sql_names(expr)}, cast([] as varchar[]))"


def sql_unique_gene(expr: str) -> str:
    return f"(case when len({sql_names(expr)}) = 1 then ({sql_names(expr)})[1] end)"
