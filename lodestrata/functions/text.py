"""Lines, white space and HTML escapes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.constants import FLAGS, FLAGS_ANY_CASE, FOOTER_LINE, NOISE_LINE


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once however often body uses it (within functions of arrays, too)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def collapse(text: Column) -> Column:
    """Each run of white space as one blank."""
    return F.regexp_replace(text, FLAGS + r"\s+", " ")


def stripped(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.regexp_replace(text, FLAGS + r"^\s+|\s+\z", "")


def clean_line(raw: Column) -> Column:
    return F.trim(collapse(raw))


def raw_lines(text: Column) -> Column:
    return F.split(text, "\n")


def is_noise(line: Column) -> Column:
    """A blank line, a page number or a reference to the table of contents."""
    return (line == "") | line.rlike(FLAGS_ANY_CASE + NOISE_LINE)


def footer_label(line: Column) -> Column:
    """The label of a line "label | page", else null."""
    return F.nullif(F.regexp_extract(line, FLAGS + FOOTER_LINE, 1), F.lit(""))


def html_escape(text: Column) -> Column:
    """Text for HTML; "$" is escaped as well, so that amounts are not read as formulas."""
    # The escapes, "&" first.
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("$", "&#36;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text
