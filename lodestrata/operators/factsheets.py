"""Fact sheets: quotes that must be found once, values, ratios, and the sheet itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.constants import FACT_TOPICS
from lodestrata.functions.facts import fact_value, number_text, ratio_text
from lodestrata.functions.labels import statement_name
from lodestrata.operators.passages import lines_holding as holding

#: facts: key, ord, id, topic, label, section, statement (null: the whole Item), quote, value, unit.
#: lines: key, section, statement, text (as of statements.statement_lines).


def scope_lines(lines: DataFrame, facts: DataFrame, key: str = "ticker") -> DataFrame:
    """key, id and text of each line of each fact's Item, or of its statement within it."""
    wanted = facts.select(key, "id", "section", F.col("statement").alias("_statement"))
    met = lines.select(key, "section", "statement", "text").join(wanted, [key, "section"])
    return met.filter(F.col("_statement").isNull() | (F.col("_statement") == F.col("statement"))).select(key, "id", "text")


def _counted(lines: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """facts with n_lines: on how many distinct lines of its scope each quote stands. Each distinct line of an Item and each distinct
    quote are looked at once, however many facts have it, see passages.lines_holding(); the statement is held against the lines
    that were found."""
    scope = [key, "section"]
    asked = [*scope, "quote", "_named", "_statement"]
    placed = facts.withColumns({"_named": F.col("statement").isNotNull(), "_statement": F.coalesce("statement", F.lit(""))})
    quotes = placed.groupBy(*scope, F.col("quote").alias("_p")).agg(F.collect_set(F.struct("_named", "_statement")).alias("_asked"))
    distinct = lines.select(*scope, "statement", F.col("text").alias("_t")).distinct()
    met = holding(distinct, quotes, scope).select(*scope, F.col("_p").alias("quote"), "statement", "_t", F.inline("_asked"))
    found = met.filter(~F.col("_named") | (F.col("_statement") == F.col("statement")))
    counted = found.groupBy(*asked).agg(F.count_distinct("_t").alias("n_lines")).hint("merge")
    return placed.join(counted, asked, "left").drop("_named", "_statement").withColumn("n_lines", F.coalesce("n_lines", F.lit(0)))


def quote_lines(lines: DataFrame, facts: DataFrame, key: str = "ticker") -> DataFrame:
    """key, id, n_lines: on how many distinct lines of its scope each quote stands."""
    return _counted(lines, facts, key).select(key, "id", "n_lines")


def fact_problems(lines: DataFrame, facts: DataFrame, key: str = "ticker") -> DataFrame:
    """key, id, problem: quotes that are not on just one line, and values that are not in their quotes."""
    where = F.concat_ws(" ", F.concat(F.lit("Item "), "section"), "statement")
    checked = _counted(lines, facts, key).withColumn("_where", where)
    problem = F.when(F.col("n_lines") != 1, F.concat(F.lit("quote found on "), F.col("n_lines").cast("string"), F.lit(" distinct lines of "), "_where")).when(
        F.col("value").isNotNull() & ~F.contains("quote", F.col("value")), F.concat(F.lit("value "), "value", F.lit(" is not in the quote"))
    )
    return checked.select(key, "id", problem.alias("problem")).filter("problem IS NOT NULL")


def fact_values(facts: DataFrame, key: str = "ticker") -> DataFrame:
    """key, id, amount (millions; null without a dollar value). A value that is not in its quote raises an error when run."""
    bad = F.concat("id", F.lit(": value "), "value", F.lit(" is not in the quote"))
    amount = fact_value(F.col("value"), F.col("unit"))
    return facts.select(key, "id", F.when(F.col("value").isNull() | F.contains("quote", F.col("value")), amount).otherwise(F.raise_error(bad)).alias("amount"))


def ratio_terms(ratios: DataFrame, key: str = "ticker") -> DataFrame:
    """key, label, side (numerator, denominator), pos, sign, id: the terms of ratios; "-" before a term subtracts it."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("terms")) for s in ("numerator", "denominator")])
    each = ratios.select(key, "label", F.inline(sides)).select(key, "label", "side", F.posexplode("terms").alias("pos", "term"))
    minus = F.startswith("term", F.lit("-"))
    return each.select(key, "label", "side", "pos", F.when(minus, -1).otherwise(1).alias("sign"), F.regexp_replace("term", "^-", "").alias("id"))


def ratio_values(ratios: DataFrame, values: DataFrame, key: str = "ticker") -> DataFrame:
    """key, label, formula, ratio, shown, missing (ids of terms without an amount; the rest is then null)."""
    met = ratio_terms(ratios, key).join(values, [key, "id"], "left")
    sign = F.when(F.col("sign") < 0, "- ").when(F.col("pos") > 0, "+ ").otherwise("")
    terms = F.sort_array(F.collect_list(F.struct("pos", F.concat(sign, number_text(F.col("amount"))).alias("text"))))
    side = met.groupBy(key, "label", "side").agg(
        F.sum(F.col("sign") * F.col("amount")).alias("total"), F.transform(terms, lambda t: t["text"]).alias("terms"),
        F.array_sort(F.collect_list(F.when(F.col("amount").isNull(), F.col("id")))).alias("gone"),
    )
    text = F.when(F.size("terms") > 1, F.concat(F.lit("("), F.array_join("terms", " "), F.lit(")"))).otherwise(F.array_join("terms", " "))
    of = lambda s, c: F.max(F.when(F.col("side") == s, c))
    both = side.withColumn("text", text).groupBy(key, "label").agg(
        F.concat(of("numerator", F.col("text")), F.lit(" / "), of("denominator", F.col("text"))).alias("formula"),
        F.try_divide(of("numerator", F.col("total")), of("denominator", F.col("total"))).alias("ratio"),
        F.concat(F.coalesce(of("numerator", F.col("gone")), F.array().cast("array<string>")), F.coalesce(of("denominator", F.col("gone")), F.array().cast("array<string>"))).alias("missing"),
    )
    whole = F.size("missing") == 0
    return both.select(key, "label", F.when(whole, F.col("formula")).alias("formula"), F.when(whole, F.col("ratio")).alias("ratio"), F.when(whole, ratio_text(F.col("ratio"))).alias("shown"), "missing")


def fact_source(section: Column, resolved_from: Column, statement: Column) -> Column:
    led = F.when(F.coalesce(resolved_from, F.lit("")) != "", F.concat(F.lit(" ("), resolved_from, F.lit(")"))).otherwise("")
    return F.concat_ws(" · ", F.concat(F.lit("Item "), section, led), statement_name(statement))


def _topic_order(topic: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, FACT_TOPICS)), topic)


def sheets(pins: DataFrame, sections: DataFrame, facts: DataFrame, ratios: DataFrame, notes: DataFrame, key: str = "ticker") -> DataFrame:
    """key, sheet: a Markdown sheet for each pin that has facts. ratios: key, ord, topic, label, numerator,
    denominator; notes: key, ord, note; sections: key, section, resolved_from. One document a company."""
    placed = facts.join(sections.select(key, "section", "resolved_from"), [key, "section"], "left")
    fact_line = F.concat(F.lit("- **"), "label", F.lit("**: “"), "quote", F.lit("” ("), fact_source(F.col("section"), F.col("resolved_from"), F.col("statement")), F.lit(")"))
    valued = ratios.join(ratio_values(ratios, fact_values(facts, key), key).select(key, "label", "formula", "shown"), [key, "label"])
    ratio_line = F.concat(F.lit("| "), "label", F.lit(" | "), "formula", F.lit(" | "), "shown", F.lit(" |"))
    head = F.concat(
        F.lit("# "), "company", F.lit(" ("), "ticker", F.lit(") · "), "form", F.lit(" FY"), F.col("fiscal_year").cast("string"),
        F.lit("\n\nFact sheet. Filing: ["), "accession", F.lit("]("), "source_url", F.lit("), period ended "), "period_end",
        F.lit(".\nFacts are quoted from the parsed filing, each checked to stand on one line of it; ratios are worked out from the quoted values, in $ millions.\n"),
    )
    topics = F.create_map(*[F.lit(x) for pair in FACT_TOPICS.items() for x in pair])
    titles = facts.select(key).distinct().select(key, F.explode(F.array(*map(F.lit, FACT_TOPICS))).alias("topic"))
    row = lambda df, order, part, at, text: df.select(F.col(key), order.alias("a"), F.lit(part).alias("b"), at.cast("long").alias("c"), text.alias("line"))
    topic_at = _topic_order(F.col("topic")).cast("long")
    table = valued.select(key, "topic").distinct()
    parts = [
        row(titles, topic_at, 0, F.lit(0), F.concat(F.lit("## "), topics[F.col("topic")], F.lit("\n"))),
        row(placed, topic_at, 1, F.col("ord"), fact_line),
        row(table, topic_at, 2, F.lit(0), F.lit("\n| Computed ratio | Formula ($ millions) | Value |\n|---|---|---|")),
        row(valued, topic_at, 3, F.col("ord"), ratio_line),
        row(titles, topic_at, 4, F.lit(0), F.lit("")),
        row(notes.select(key).distinct(), F.lit(99).cast("long"), 0, F.lit(0), F.lit("## Notes\n")),
        row(notes, F.lit(99).cast("long"), 1, F.col("ord"), F.concat(F.lit("- "), "note")),
        row(notes.select(key).distinct(), F.lit(99).cast("long"), 2, F.lit(0), F.lit("")),
    ]
    body = parts[0]
    for part in parts[1:]:
        body = body.unionByName(part)
    text = body.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("a", "b", "c", "line"))), lambda r: r["line"]), "\n").alias("_body"))
    return pins.join(text, key).select(key, F.concat_ws("\n", head, "_body").alias("sheet"))

