"""Figures that an answer states, and whether the passages it cites hold their values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.constants import ANSWER_NUMBER, FLAGS, PASSAGE_NUMBER, PLAIN_YEAR
from lodestrata.functions.citations import cited_numbers, without_citations
from lodestrata.functions.text import let, stripped

#: What stands before and after a number is matched too, as matches carry no positions.
_WITH_CONTEXT = FLAGS + r"(≈\s*)?" + ANSWER_NUMBER + r"(\s*[x×])?"
_PARTS, _MARK = "$1\x1f$2\x1f$3\x1f$4\x1f$5", "\x1f"


def number_value(text: Column) -> Column:
    """A number's value as text: no separators, no leading zeros, no trailing zeros after the point. Equal
    values are equal texts, at any length."""
    plain = F.regexp_replace(F.replace(text, F.lit(","), F.lit("")), "^0+([0-9])", "$1")
    return F.when(F.contains(plain, F.lit(".")), F.regexp_replace(plain, r"\.?0*$", "")).otherwise(plain)


def figure_matches(answer: Column) -> Column:
    """array<struct<figure, approximate, value>>: the figures of an answer, in order, each pair once.

    Counted are numbers with a dollar or percent sign, a separator or decimals, or of three digits or more;
    citations and plain years are not. approximate: a percentage or multiple with "≈" before it."""
    matches = F.regexp_extract_all(without_citations(answer), F.lit(_WITH_CONTEXT), F.lit(0))

    def parts(match: Column) -> Column:
        cut = F.split(F.regexp_replace(match, _WITH_CONTEXT, _PARTS), _MARK, -1)
        return let(cut, lambda c: F.struct(*[c[i].alias(name) for i, name in enumerate(("sign", "dollar", "number", "percent", "times"))]))

    def counts(m: Column) -> Column:
        marked = (m["dollar"] != "") | (m["percent"] != "")
        long = F.contains(m["number"], F.lit(",")) | F.contains(m["number"], F.lit(".")) | (F.length(m["number"]) >= 3)
        return marked | (long & ~m["number"].rlike(PLAIN_YEAR))

    def shown(m: Column) -> Column:
        figure = F.concat(stripped(F.concat(m["dollar"], m["number"], m["percent"])), stripped(m["times"]))
        approximate = (m["sign"] != "") & ((m["percent"] != "") | (m["times"] != ""))
        return F.struct(figure.alias("figure"), approximate.alias("approximate"), number_value(m["number"]).alias("value"))

    return F.array_distinct(F.transform(F.filter(F.transform(matches, parts), counts), shown))


def answer_figures(answer: Column) -> Column:
    return F.array_distinct(F.transform(figure_matches(answer), lambda f: f["figure"]))


def passage_values(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(PASSAGE_NUMBER), F.lit(0)), number_value)


def _unverified(figures: Column, held: Column, allow_approximate: bool) -> Column:
    left = F.filter(figures, lambda f: ~F.array_contains(held, f["value"]) & (~f["approximate"] if allow_approximate else F.lit(True)))
    return F.array_distinct(F.transform(left, lambda f: f["figure"]))


def _values(texts: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(texts, passage_values)))


def unverified_figures(answer: Column, cited_texts: Column, allow_approximate: bool = False) -> Column:
    """The figures whose value none of the cited texts (an array) holds."""
    known = F.struct(figure_matches(answer).alias("figures"), _values(cited_texts).alias("held"))
    return let(known, lambda k: _unverified(k["figures"], k["held"], allow_approximate))


def check_answer(answer: Column, passages: Column, allow_approximate: bool = False) -> Column:
    """struct<cited, invalid_citations, unverified_figures, approximate_ratios> of an answer and its passages
    (array<struct<n, text, ...>>, numbered from 1). approximate_ratios is null where they are not allowed."""

    def checked(k: Column) -> Column:
        ratios = F.array_distinct(F.transform(F.filter(k["figures"], lambda f: f["approximate"]), lambda f: F.concat(F.lit("≈ "), f["figure"])))
        return F.struct(
            k["cited"].alias("cited"),
            F.filter(k["cited"], lambda n: (n < 1) | (n > k["n"])).alias("invalid_citations"),
            _unverified(k["figures"], k["held"], allow_approximate).alias("unverified_figures"),
            (ratios if allow_approximate else F.lit(None).cast("array<string>")).alias("approximate_ratios"),
        )

    def known(cited: Column) -> Column:
        texts = F.transform(F.filter(passages, lambda p: F.array_contains(cited, p["n"].cast("long"))), lambda p: p["text"])
        return F.struct(cited.alias("cited"), F.size(passages).alias("n"), figure_matches(answer).alias("figures"), _values(texts).alias("held"))

    return let(let(cited_numbers(answer), known), checked)
