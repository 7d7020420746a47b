"""The primary statements of Item 8, and the rows that scoring reads from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.constants import CASH_DEBT_ROW, CURRENT_HEADING, FLAGS_ANY_CASE, NOTES_HEADING, SCALE_FIELDS, STATEMENT_HEADING, STATEMENT_KINDS, UNITS_LINE
from lodestrata.operators.sections import joined_lines


def statement_kind(line: Column) -> Column:
    """The kind of a primary statement's heading, "" for another statement's or the notes', else null."""
    name = F.regexp_extract(line, FLAGS_ANY_CASE + STATEMENT_HEADING, 1)
    kind = F.lit("")
    for value, pattern in STATEMENT_KINDS.items():
        kind = F.when(name.rlike(FLAGS_ANY_CASE + pattern), value).otherwise(kind)
    return F.when(name != "", kind).when(line.rlike(FLAGS_ANY_CASE + NOTES_HEADING), "")


def statement_lines(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, section, line_no, text, part_no, statement of each line of each section (section, text).

    Only Item 8 is parted. A heading opens a part unless both it and what goes on before it are no primary
    statement; the last heading's kind is what goes on, so one running sum numbers the parts."""
    lines = sections.select(key, "section", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    by_line = Window.partitionBy(key, "section").orderBy("line_no")
    kind = F.when(F.col("section") == "8", statement_kind(F.col("text")))
    upto = by_line.rowsBetween(Window.unboundedPreceding, 0)
    known = lines.withColumn("_kind", kind)
    going = known.withColumn("_going", F.coalesce(F.last("_kind", ignorenulls=True).over(by_line.rowsBetween(Window.unboundedPreceding, -1)), F.lit("")))
    opens = F.col("_kind").isNotNull() & ((F.col("_kind") != "") | (F.col("_going") != ""))
    return going.select(
        key, "section", "line_no", "text",
        F.sum(F.when(opens, 1).otherwise(0)).over(upto).cast("int").alias("part_no"),
        F.coalesce(F.last("_kind", ignorenulls=True).over(upto), F.lit("")).alias("statement"),
    )


def statement_parts(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, section, part_no (rising, not gapless), statement, text, n_lines: the parts of each section."""
    groups = statement_lines(sections, key).groupBy(key, "section", "part_no")
    return groups.agg(F.first("statement").alias("statement"), joined_lines(F.col("line_no"), F.col("text")).alias("text"), F.count("*").alias("n_lines"))


def sections_with_parts(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """sections with `parts`, array<struct<part_no, statement, text>> in order. Only Item 8 is exploded."""
    whole = sections.filter(F.col("section") != "8").withColumn("parts", F.array(F.struct(F.lit(0).alias("part_no"), F.lit("").alias("statement"), F.col("text").alias("text"))))
    eight = sections.filter(F.col("section") == "8")
    parted = statement_parts(eight, key).groupBy(key, "section").agg(F.sort_array(F.collect_list(F.struct("part_no", "statement", "text"))).alias("parts"))
    return whole.unionByName(eight.join(parted, [key, "section"]))


def pinned_rows(pins: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, ord, name, label: the income rows that each filing pins."""
    each = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(name).alias("name"), F.col(field).alias("label")) for i, (name, field) in enumerate(SCALE_FIELDS.items())])
    return pins.select(key, F.inline(each))


def scale_matches(income: DataFrame, pins: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, ord, name, label, n_matches, row: the distinct rows of an income statement (key, line_no, text)
    under each pinned label. Pins are one row a filing: the join is on the filing's key."""
    rows = income.filter(F.contains(F.col("text"), F.lit(" |"))).select(F.col(key).alias("_key"), "text")
    under = (F.col(key) == F.col("_key")) & F.startswith(F.col("text"), F.concat(F.col("label"), F.lit(" |")))
    met = pinned_rows(pins, key).join(rows, under, "left")
    found = met.groupBy(key, "ord", "name", "label").agg(F.count_distinct("text").alias("n_matches"), F.min("text").alias("row"))
    return found


def units_lines(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, units: the first line that tells the units of a statement."""
    told = lines.filter(F.col("text").rlike(FLAGS_ANY_CASE + UNITS_LINE))
    return told.groupBy(key).agg(F.min_by("text", "line_no").alias("units"))


def scale_lines(income: DataFrame, pins: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, ord, name, row: the pinned rows. Running it raises an error unless each label has exactly one distinct row."""
    matches = scale_matches(income, pins, key)
    wrong = F.concat(F.col(key).cast("string"), F.lit(": "), F.col("n_matches").cast("string"), F.lit(" income-statement rows labelled '"), "label", F.lit("'"))
    return matches.select(key, "ord", "name", F.when(F.col("n_matches") == 1, F.col("row")).otherwise(F.raise_error(wrong)).alias("row"))


def scale_texts(income: DataFrame, pins: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, text: the units line (if any) and the pinned rows, one a line."""
    rows = scale_lines(income, pins, key).groupBy(key).agg(joined_lines(F.col("ord"), F.col("row")).alias("_rows"))
    return rows.join(units_lines(income, key), key, "left").select(key, F.concat_ws("\n", "units", "_rows").alias("text"))


def cash_debt_lines(balance: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, line_no, part, text: a balance sheet's units line, cash, investment and debt rows and current totals,
    in order. Repeated rows come once; a heading comes only right before the first new row below it (part 0)."""
    by_line = Window.partitionBy(key).orderBy("line_no")
    text = F.col("text")
    is_heading = text.rlike(FLAGS_ANY_CASE + CURRENT_HEADING)
    is_units = text.rlike(FLAGS_ANY_CASE + UNITS_LINE)
    is_row = text.rlike(FLAGS_ANY_CASE + CASH_DEBT_ROW) & ~is_heading
    kinds = balance.select(key, "line_no", "text", is_heading.alias("_heading"), is_units.alias("_units"), is_row.alias("_any"))
    upto = by_line.rowsBetween(Window.unboundedPreceding, 0)
    heading = F.when(F.col("_heading"), F.struct("line_no", "text"))
    # The window by document comes first: its exchange then serves the window by document and text as well.
    last = kinds.withColumn("_under", F.last(heading, ignorenulls=True).over(upto))
    under = last.withColumn("_row", F.col("_any") & (F.col("line_no") == F.min("line_no").over(Window.partitionBy(key, "text"))))
    rows_before = F.coalesce(F.sum(F.when(F.col("_row"), 1).otherwise(0)).over(by_line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    units_before = F.coalesce(F.sum(F.when(F.col("_units"), 1).otherwise(0)).over(by_line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = under.withColumn("_opens", F.col("_units") & (rows_before == 0) & (units_before == 0))
    first_under = F.min(F.when(F.col("_row"), F.col("line_no"))).over(Window.partitionBy(key, F.col("_under.line_no")))
    out = F.when(
        F.col("_row"),
        F.when(F.col("_under").isNotNull() & (F.col("line_no") == first_under), F.array(F.struct(F.lit(0).alias("part"), F.col("_under.text").alias("text")), F.struct(F.lit(1).alias("part"), text.alias("text")))).otherwise(
            F.array(F.struct(F.lit(1).alias("part"), text.alias("text")))
        ),
    ).when(F.col("_opens"), F.array(F.struct(F.lit(1).alias("part"), text.alias("text"))))
    return counted.withColumn("_out", out).filter("_out IS NOT NULL").select(key, "line_no", F.inline("_out"))


def cash_debt_texts(balance: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, text: those lines joined; only of balance sheets that have a row among them."""
    rows = F.sort_array(F.collect_list(F.struct("line_no", "part", "text")))
    joined = cash_debt_lines(balance, key).groupBy(key).agg(F.transform(rows, lambda r: r["text"]).alias("_lines"))
    return joined.filter(F.exists("_lines", lambda t: F.contains(t, F.lit("|")))).select(key, F.array_join("_lines", "\n").alias("text"))
