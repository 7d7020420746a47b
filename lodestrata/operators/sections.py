"""Lines to Items. All windows are by document, so that one exchange serves the whole scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.constants import FLAGS_ANY_CASE, ITEM_HEADING, ITEMS, KEPT_ITEMS, MIN_BODY_CHARS, OWN, POINTER, POINTER_MAX_CHARS, POINTER_RESOLVED, SHORT_UNRESOLVED
from lodestrata.functions.text import clean_line, let, stripped


def heading_item(text: Column) -> Column:
    """The Item that a line heads, else null."""
    item = F.upper(F.regexp_extract(text, FLAGS_ANY_CASE + ITEM_HEADING, 1))
    return F.when(item.isin(*ITEMS), item)


def item_rank(item: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, ITEMS)), item).cast("int") - 1


def sectioned_lines(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """The lines with item (the last heading's, null before the first), is_heading, rank (of headings) and title
    (of headings: what follows the number, else the next line, else empty).

    The body starts at the first heading of Item 1 that a body's worth of text follows; what is above is a
    table of contents. A later heading counts if it ranks above all candidates before it: the last one that
    counted always ranks highest so far, so that a running maximum finds the same headings as a scan.
    Lines are read once; all windows share one exchange."""
    whole, by_line = Window.partitionBy(key), Window.partitionBy(key).orderBy("line_no")
    upto, before = by_line.rowsBetween(Window.unboundedPreceding, 0), by_line.rowsBetween(Window.unboundedPreceding, -1)
    c = F.col
    following = F.expr(f"lead(_above) IGNORE NULLS OVER (PARTITION BY `{key}` ORDER BY line_no)")
    scan = lines.withColumns({"_candidate": heading_item(c("text")), "_size": F.length("text")})
    scan = scan.withColumns({"_through": F.sum("_size").over(upto), "_total": F.sum("_size").over(whole), "_next": F.lead("text").over(by_line)})
    scan = scan.withColumn("_above", F.when(c("_candidate").isNotNull(), c("_through") - c("_size")))
    opens = (c("_candidate") == ITEMS[0]) & (F.coalesce(following, c("_total")) - c("_through") >= MIN_BODY_CHARS)
    scan = scan.withColumn("_opens", F.when(opens, c("line_no")))
    scan = scan.withColumn("_rank", F.when(c("_candidate").isNotNull() & (c("line_no") >= F.min("_opens").over(whole)), item_rank(c("_candidate"))))
    scan = scan.withColumn("is_heading", F.coalesce(c("_rank") > F.coalesce(F.max("_rank").over(before), F.lit(-1)), F.lit(False)))
    told = F.rtrim(stripped(F.regexp_extract("text", FLAGS_ANY_CASE + ITEM_HEADING, 2)), F.lit("."))
    return scan.select(
        *lines.columns,
        F.last(F.when(c("is_heading"), c("_candidate")), ignorenulls=True).over(upto).alias("item"),
        "is_heading",
        F.when(c("is_heading"), c("_rank")).alias("rank"),
        F.when(c("is_heading"), F.coalesce(F.nullif(told, F.lit("")), c("_next"), F.lit(""))).alias("title"),
    )


def find_headings(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, line_no, item, title (what follows the number), rank: the headings of a report's body, in strictly
    rising order of Items."""
    title = stripped(F.regexp_extract("text", FLAGS_ANY_CASE + ITEM_HEADING, 2))
    return sectioned_lines(lines, key).filter("is_heading").select(key, "line_no", "item", title.alias("title"), "rank")


def joined_lines(line_no: Column, text: Column) -> Column:
    """Aggregate: the lines of a group in order, joined by line ends."""
    rows = F.sort_array(F.collect_list(F.struct(line_no.alias("at"), text.alias("text"))))
    return F.array_join(F.transform(rows, lambda r: r["text"]), "\n")


def pointer_name(text: Column) -> Column:
    """What part of Item 7 a short Item 7A points to, else null."""
    name = F.regexp_extract(clean_line(text), FLAGS_ANY_CASE + POINTER, 1)
    return F.nullif(stripped(name), F.lit(""))


def _text_of(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: r["text"]), "\n")


def _part_under(rows: Column, name: Column) -> Column:
    """The text from below the first all-bold row of that name to the next heading that is as large, else null."""
    starts = F.filter(rows, lambda r: (F.lower(r["text"]) == F.lower(name)) & r["heading_size"].isNotNull())

    def below(first: Column) -> Column:
        later = F.filter(rows, lambda r: r["at"] > first["at"])
        end = F.get(F.filter(later, lambda r: r["heading_size"] >= first["heading_size"]), F.lit(0))["at"].cast("long")
        return let(F.coalesce(end, F.lit((1 << 63) - 1)), lambda stop: _text_of(F.filter(later, lambda r: r["at"] < stop)))

    return F.when(F.size(starts) > 0, F.nullif(let(F.get(starts, F.lit(0)), below), F.lit("")))


def split_sections(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, section, title, text, content_source, resolved_from for each kept Item of each document.

    lines: key, line_no, text, heading_size. A short Item 7A that points into Item 7 gets the text of the
    part it names; if there is none, it is short_unresolved. The Items of a document meet in one row of it,
    as the document itself did, so that the exchange by document serves here too."""
    row = F.when(~F.col("is_heading"), F.struct(F.col("line_no").alias("at"), "text", "heading_size"))
    found = sectioned_lines(lines, key).filter(F.col("item").isin(*KEPT_ITEMS)).groupBy(key, F.col("item").alias("section"))
    sections = found.agg(F.max("title").alias("title"), F.sort_array(F.collect_list(row)).alias("rows"))
    docs = sections.groupBy(key).agg(F.collect_list(F.struct("section", "title", "rows")).alias("_sections"))
    rows_of = lambda item: F.get(F.filter("_sections", lambda s: s["section"] == item), F.lit(0))["rows"]
    own = docs.withColumn("_own", F.coalesce(_text_of(rows_of("7A")), F.lit("")))
    named = own.withColumn("_name", F.when(F.length("_own") < POINTER_MAX_CHARS, pointer_name(F.col("_own"))))
    led = named.withColumn("_led", F.when(F.col("_name").isNotNull(), _part_under(rows_of("7"), F.col("_name"))))
    each = led.select(key, F.length("_own").alias("_chars"), "_name", "_led", F.inline("_sections"))
    is_7a = F.col("section") == "7A"
    resolved = is_7a & F.col("_led").isNotNull()
    return each.select(
        key, "section", "title",
        F.when(resolved, F.col("_led")).otherwise(_text_of(F.col("rows"))).alias("text"),
        F.when(resolved, POINTER_RESOLVED).when(is_7a & (F.col("_chars") < POINTER_MAX_CHARS), SHORT_UNRESOLVED).otherwise(OWN).alias("content_source"),
        F.when(resolved, F.concat(F.lit("Item 7, "), "_name")).otherwise("").alias("resolved_from"),
    )


def describe_7a(content_source: Column, resolved_from: Column) -> Column:
    return (
        F.when(content_source == POINTER_RESOLVED, F.concat(F.lit("pointer resolved to "), resolved_from))
        .when(content_source == SHORT_UNRESOLVED, F.lit("short, pointer not resolved: risk scoring also reads Item 7"))
        .otherwise(F.lit("own content"))
    )
