"""Column expressions that clean and parse text fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Spellings of a missing value, of yes and of no.
NULL_TOKENS = ("", "none", "nan", "null", "unknown", "n/a", "na", "-", "not reported", "not specified")
YES, NO = ("1", "true", "t", "yes", "y"), ("0", "false", "f", "no", "n")
NUMBER = r"[-+]?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?"


def normal_space(text: Column) -> Column:
    """Dashes to '-', runs of white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(text, "‐‑‒–—−", "------"), r"[ \t\n\r\f\x0b]{2,}|[\t\n\r\f\x0b]", " "))  # a single blank is left as it is


def clean_null(text: Column) -> Column:
    """Null where the trimmed text spells a missing value."""
    return F.when(~F.lower(F.trim(text)).isin(*NULL_TOKENS), F.trim(text))


def yes_no(text: Column) -> Column:
    """True, false, or null where the text is neither a yes nor a no."""
    t = F.lower(F.trim(text))
    return F.when(t.isin(*YES), True).when(t.isin(*NO), False)


def parse_list(text: Column) -> Column:
    """A JSON list of strings, else pieces between ; , | / and the word 'and': trimmed, without missing values, distinct in order."""
    pieces = F.coalesce(F.when(text.rlike(r"^\s*\["), F.from_json(text, "array<string>")), F.split(text, r"\s*[;,|/]\s*|\s+and\s+"))
    return F.array_distinct(F.filter(F.transform(pieces, clean_null), lambda x: x.isNotNull()))


def clip(text: Column, n: int, mark: str = " ...[TRUNCATED]") -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.rtrim(F.substring(text, 1, n)), F.lit(mark))).otherwise(text)


def number(text: Column) -> Column:
    """The first number, with a Unicode minus and commas between thousands allowed."""
    plain = F.regexp_replace(F.translate(text, "−", "-"), r",(?<=[0-9],)(?=[0-9]{3})", "")
    return F.nullif(F.regexp_extract(plain, NUMBER, 0), F.lit("")).try_cast("double")


def value_and_unit(text: Column, units: Sequence[str] = ("meV", "eV", "kJ/mol", "kcal/mol")) -> tuple[Column, Column]:
    """The first number that a unit may follow, and the unit (eV where there is none)."""
    pattern = rf"({NUMBER})(?:\s*({'|'.join(units)}))?"
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("double"), F.coalesce(F.nullif(F.regexp_extract(text, pattern, 2), F.lit("")), F.lit("eV"))


def capped_score(text: Column, terms: Sequence[tuple[str, float, float]]) -> Column:
    """The sum of min(cap, weight * hits) over (pattern, weight, cap), at most 1, rounded to 4 places; 0 for null."""
    total = F.lit(0.0)
    for pattern, weight, cap in terms:
        total = total + F.least(F.lit(cap), F.lit(weight) * F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)))
    return F.round(F.least(total, F.lit(1.0)), 4)


def first_rule(text: Column, rules: Sequence[tuple[str, str]], other: str) -> Column:
    """The name of the first (pattern, name) whose pattern the text has."""
    out = F.lit(None)
    for pattern, name in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return F.coalesce(out, F.lit(other))


def numbers_of(text: Column) -> Column:
    """All numbers of a text."""
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda x: x.try_cast("double"))


def number_among(value: Column, numbers: Column, relative: float = 0.005, absolute: float = 0.015) -> Column:
    """Whether one of numbers is within max(absolute, relative * |value|) of value; null values are not supported."""
    return F.coalesce(F.exists(numbers, lambda x: F.abs(x - value) <= F.greatest(F.lit(absolute), relative * F.abs(value))), F.lit(False))


def number_supported(value: Column, evidence: Column, relative: float = 0.005, absolute: float = 0.015) -> Column:
    """Whether evidence has a number within max(absolute, relative * |value|) of value; null values are not supported."""
    return number_among(value, numbers_of(evidence), relative, absolute)


def formula(text: Column) -> Column:
    """struct(atoms, species, major, oxide) of a formula such as Fe2O3; a symbol without a count counts one, ties go to the earlier symbol."""
    parts = F.regexp_extract_all(text, F.lit("([A-Z][a-z]?)([0-9]*)"), F.lit(0))
    each = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, "^[A-Z][a-z]?", 0).alias("s"), F.coalesce(F.nullif(F.regexp_extract(p, "[0-9]+$", 0), F.lit("")).try_cast("long"), F.lit(1)).alias("n")))
    add = lambda e: F.aggregate(e, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    names = F.array_distinct(F.transform(each, lambda x: x["s"]))
    totals = F.transform(names, lambda s, i: F.struct(add(F.filter(each, lambda x: x["s"] == s)).alias("n"), (-i).alias("o"), s.alias("s")))
    return F.struct(add(each).alias("atoms"), F.size(names).cast("long").alias("species"), F.array_max(totals)["s"].alias("major"), F.array_contains(names, "O").alias("oxide"))


def key_values(columns: Sequence[str]) -> Column:
    """'k=v ; k=v' of the columns that are not null."""
    return F.concat_ws(" ; ", *(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in columns))


def miller(text: Column) -> Column:
    """'110' or '1 1 0' or '(1,1,0)' as '(1 1 0)'; '(? ? ?)' for anything else."""
    digits = F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*\(?\s*(-?[0-9])[ ,]*(-?[0-9])[ ,]*(-?[0-9])\s*\)?\s*$", 0)
    parts = F.regexp_extract_all(digits, F.lit("-?[0-9]"), F.lit(0))
    return F.when(F.size(parts) == 3, F.concat(F.lit("("), F.array_join(parts, " "), F.lit(")"))).otherwise(F.lit("(? ? ?)"))
