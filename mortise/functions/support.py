"""Whether a record's fields are borne out by its evidence text, and what remains of them.

Evidence is a text, or what with_evidence() has read of it: a long text that several fields are held against is then read once a row.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from mortise.functions.parsing import clean_null, normal_space, number_among, numbers_of

#: Runs that count as one word where fields and evidence are compared.
WORD = r"[A-Za-z][A-Za-z0-9+\-]*"


def _words(plain: Column, least: int = 3) -> Column:
    """The words of a text that has no null and single blanks."""
    return F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(plain, F.lit(f"{WORD[:-1]}{{{least - 1},}}"), F.lit(0))), F.lower))


def words_of(text: Column, least: int = 3) -> Column:
    """Distinct lower-cased words of at least that many characters; none for null."""
    return _words(F.coalesce(normal_space(text), F.lit("")), least)


class Evidence(NamedTuple):
    """What fields are held against: the lower-cased text with single blanks (empty for null), its words and its numbers."""

    low: Column
    words: Column
    numbers: Column


def evidence_of(text: Column | Evidence) -> Evidence:
    if isinstance(text, Evidence):
        return text
    e = F.coalesce(normal_space(text), F.lit(""))
    return Evidence(F.lower(e), _words(e), numbers_of(text))


def with_evidence(df: DataFrame, text: str) -> tuple[DataFrame, Evidence]:
    """df with the columns of the evidence that text is, and the evidence. As they are used more than once, Spark keeps them in a projection of their own."""
    held = df.withColumn("plain_", F.coalesce(normal_space(F.col(text)), F.lit("")))
    held = held.withColumns({"low_": F.lower("plain_"), "words_": _words(F.col("plain_")), "numbers_": numbers_of(F.col(text))}).drop("plain_")
    return held, Evidence(F.col("low_"), F.col("words_"), F.col("numbers_"))


def shared_words(a: Column, b: Column, least: int = 3) -> Column:
    """How many words two texts have in common."""
    return F.size(F.array_intersect(words_of(a, least), words_of(b, least)))


def text_supported(value: Column, evidence: Column | Evidence, least: int = 1) -> Column:
    """Whether evidence holds value, in any case, or shares that many words with it. A value that is null or blank has no support; without evidence any other value passes."""
    v, e = F.coalesce(normal_space(value), F.lit("")), evidence_of(evidence)
    own = words_of(v)
    share = F.arrays_overlap(own, e.words) if least == 1 else F.size(F.array_intersect(e.words, own)) >= least
    return (v != "") & ((e.low == "") | F.contains(e.low, F.lower(v)) | share)


def number_status(value: Column, evidence: Column | Evidence, unsupported: str = "dropped_not_in_evidence") -> Column:
    return F.when(value.isNull(), "missing").when(number_among(value.cast("double"), evidence_of(evidence).numbers), "supported").otherwise(unsupported)


def drop_unsupported(fields: Sequence[str], units: dict[str, str], evidence: Column | Evidence) -> dict[str, Column]:
    """New columns for withColumns(): each numeric field and its unit are null unless evidence has the number; number_status maps each field to missing, supported or dropped_not_in_evidence."""
    status = {f: number_status(F.col(f), evidence) for f in fields}
    out = {f: F.when(s != "dropped_not_in_evidence", F.col(f)) for f, s in status.items()}
    out |= {units[f]: F.when(status[f] != "dropped_not_in_evidence", F.col(units[f])) for f in fields if f in units}
    return out | {"number_status": F.create_map(*(x for f, s in status.items() for x in (F.lit(f), s)))}


def field_status(numbers: Sequence[str], texts: Sequence[str], evidence: Column | Evidence) -> Column:
    """Map of field to missing, supported, unsupported (numbers) or weak_or_unsupported (texts)."""
    of_text = lambda c: F.when(c.isNull() | (c == ""), "missing").when(text_supported(c, evidence), "supported").otherwise("weak_or_unsupported")
    pairs = [(f, number_status(F.col(f), evidence, "unsupported")) for f in numbers] + [(f, of_text(F.col(f))) for f in texts]
    return F.create_map(*(x for f, s in pairs for x in (F.lit(f), s)))


def status_count(status: Column, name: str) -> Column:
    """How many fields have a status that starts with name."""
    return F.size(F.filter(F.map_values(status), lambda s: s.startswith(name)))


def match_score(terms: Sequence[Column], evidence: Column | Evidence) -> Column:
    """Mean over the terms that are set: 1 if evidence holds it, .5 if they share a word, else 0; rounded to 4, 0 without terms."""
    e = evidence_of(evidence)
    given = F.filter(F.array(*(clean_null(normal_space(t)) for t in terms)), lambda t: t.isNotNull())
    worth = F.transform(given, lambda t: F.when(F.contains(e.low, F.lower(t)), 1.0).when(F.arrays_overlap(words_of(t), e.words), 0.5).otherwise(0.0))
    return F.when(F.size(given) > 0, F.round(F.aggregate(worth, F.lit(0.0), lambda a, x: a + x) / F.size(given), 4)).otherwise(0.0)
