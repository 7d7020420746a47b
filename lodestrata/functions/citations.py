"""Citations "[2]", "[1, 3]" and their full-width forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.constants import CITATION, FLAGS


def display_citations(text: Column) -> Column:
    """All citations in the plain style."""
    return F.regexp_replace(text, FLAGS + CITATION, "[$1]")


def without_citations(text: Column) -> Column:
    return F.regexp_replace(text, FLAGS + CITATION, "")


def cited_numbers(answer: Column) -> Column:
    """The cited numbers, once each, in the order of their first citation."""
    groups = F.regexp_extract_all(answer, F.lit(FLAGS + CITATION), F.lit(1))
    each = F.flatten(F.transform(groups, lambda g: F.split(F.regexp_replace(g, FLAGS + r"\s+", ""), ",")))
    return F.array_distinct(F.filter(F.transform(each, lambda n: n.try_cast("long")), lambda n: n.isNotNull()))
