"""Labels of sources and passages, and the numbered context of a prompt."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.constants import STATEMENT_NAMES


def statement_name(statement: Column) -> Column:
    """The name of a primary statement, else null."""
    named = F.lit(None).cast("string")
    for kind, name in STATEMENT_NAMES.items():
        named = F.when(statement == kind, F.lit(name)).otherwise(named)
    return named


def source_label(company: Column, form: Column, fiscal_year: Column, section: Column, resolved_from: Column) -> Column:
    """ "company · form FYyear · Item s", with what a pointer led to in parentheses."""
    led = F.when(F.coalesce(resolved_from, F.lit("")) != "", F.concat(F.lit(" ("), resolved_from, F.lit(")"))).otherwise(F.lit(""))
    return F.concat(company, F.lit(" · "), form, F.lit(" FY"), fiscal_year.cast("string"), F.lit(" · Item "), section, led)


def passage_label(company: Column, form: Column, fiscal_year: Column, section: Column, resolved_from: Column, statement: Column) -> Column:
    """The source's label with the name of the primary statement, if it is one."""
    return F.concat_ws(" · ", source_label(company, form, fiscal_year, section, resolved_from), statement_name(statement))


def filing_label(company: Column, ticker: Column, form: Column, fiscal_year: Column) -> Column:
    return F.concat(company, F.lit(" ("), ticker, F.lit(") · "), form, F.lit(" FY"), fiscal_year.cast("string"))


def numbered_context(passages: Column) -> Column:
    """Passages (array<struct<n, label, text, ...>>, in order) as "[n] label" and text, parted by blank lines."""
    return F.array_join(F.transform(passages, lambda p: F.concat(F.lit("["), p["n"].cast("string"), F.lit("] "), p["label"], F.lit("\n"), p["text"])), "\n\n")
