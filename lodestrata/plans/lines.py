"""Queries of the line operators. Where the tables have no such lines, orders are written as lines of reports:
ten customers are a document, and an order's key is the line's number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.constants import ITEMS, KEPT_ITEMS
from lodestrata.functions.text import collapse
from lodestrata.operators import chunking, html_lines, lines, sections, statements
from lodestrata.plans.registry import register, table

_CLEAN = r"trim(regexp_replace({}, '[\s\x0B\x{{85}}\p{{Z}}]+', ' ', 'g'))"
_DOC_LINES = f"""
raw AS (SELECT doc_id, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS line_no, unnest(ls) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
dl AS (SELECT doc_id, line_no, {_CLEAN.format("raw")} AS text FROM raw),
kept AS (SELECT * FROM dl WHERE text <> '' AND NOT regexp_full_match(lower(text), '[0-9]{{1,3}}|table of contents'))
"""


@register("doc_lines", f"WITH {_DOC_LINES} SELECT doc_id, line_no, text FROM kept")
def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.text_lines(table(spark, sf_dir, "documents"))


@register("first_line_occurrences", f"WITH {_DOC_LINES} SELECT doc_id, min(line_no) AS line_no, text FROM kept GROUP BY doc_id, text")
def first_line_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.first_occurrences(lines.text_lines(table(spark, sf_dir, "documents")))


@register("whitespace_collapsed", f"SELECT doc_id, md5(regexp_replace(text, '[\\s\\x0B\\x{{85}}\\p{{Z}}]+', ' ', 'g')) AS text_md5 FROM documents")
def whitespace_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(collapse(F.col("text")).cast("binary")).alias("text_md5"))


_FOOTER_TEXT = "CASE WHEN o_orderstatus = 'P' THEN concat('Order ', o_orderkey, ' | open') ELSE concat(o_orderpriority, ' | ', o_orderkey % 100) END"
_FOOTER_SQL = f"""
l AS (SELECT o_custkey AS doc_id, o_orderkey AS line_no, {_FOOTER_TEXT} AS text FROM orders),
b AS (SELECT *, regexp_extract(text, '^(.+?)\\s*\\|\\s*[0-9]{{1,3}}$', 1) AS label FROM l),
f AS (SELECT doc_id, label, count(*) AS n FROM b WHERE label <> '' GROUP BY ALL HAVING count(*) >= 5)
"""


def _footer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("line_no"), F.expr(_FOOTER_TEXT).alias("text"))


@register("footer_labels", f"WITH {_FOOTER_SQL} SELECT doc_id, label, n FROM f")
def footer_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.footer_labels(_footer_lines(spark, sf_dir))


@register("footers_stripped", f"WITH {_FOOTER_SQL} SELECT doc_id, line_no, text FROM b WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = b.doc_id AND f.label = b.label)")
def footers_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.strip_page_footers(_footer_lines(spark, sf_dir))


_HEADS = ("1", "1A", "1B", "3", "7", "7A", "8", "9")
_PICKED = "CASE CAST(floor(o_orderkey / 3) AS BIGINT) % 8 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_HEADS)) + " END"
_REPORT_TEXT = f"CASE WHEN o_orderkey % 3 = 0 THEN concat('Item ', {_PICKED}, '. ', o_orderpriority, '.') ELSE repeat(concat('order ', o_orderkey, ' '), 20) END"
_DOC = "CAST(floor(o_custkey / 10) AS BIGINT)"
_LIST = "[" + ", ".join(f"'{x}'" for x in ITEMS) + "]"
_HEAD_SQL = f"""
l AS (SELECT {_DOC} AS doc_id, o_orderkey AS line_no, {_REPORT_TEXT} AS text FROM orders),
c AS (
  SELECT *, upper(regexp_extract(text, '^(?i:item)\\s*([0-9]{{1,2}}[a-cA-C]?)\\s*[.:]\\s*(.*)$', 1)) AS item,
    sum(length(text)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS through, sum(length(text)) OVER (PARTITION BY doc_id) AS total,
    lead(text) OVER (PARTITION BY doc_id ORDER BY line_no) AS next_text
  FROM l),
k AS (SELECT *, list_position({_LIST}, item) - 1 AS rank FROM c WHERE list_contains({_LIST}, item)),
b AS (SELECT *, coalesce(lead(through - length(text)) OVER (PARTITION BY doc_id ORDER BY line_no), total) - through AS body FROM k),
s AS (SELECT *, min(CASE WHEN item = '1' AND body >= 500 THEN line_no END) OVER (PARTITION BY doc_id) AS start FROM b),
m AS (SELECT *, coalesce(max(rank) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS before FROM s WHERE line_no >= start),
h AS (SELECT doc_id, line_no, item, regexp_extract(text, '[.:]\\s*(.*)$', 1) AS title, CAST(rank AS INTEGER) AS rank, next_text FROM m WHERE rank > before)
"""


def _report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.expr(_DOC).alias("doc_id"), F.col("o_orderkey").alias("line_no"), F.expr(_REPORT_TEXT).alias("text"), F.lit(None).cast("double").alias("heading_size"))


@register("section_headings", f"WITH {_HEAD_SQL} SELECT doc_id, line_no, item, title, rank FROM h")
def section_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.find_headings(_report_lines(spark, sf_dir))


@register(
    "split_sections",
    f"""
WITH {_HEAD_SQL},
e AS (SELECT *, lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) AS until FROM h),
t AS (
  SELECT e.doc_id, e.item AS section, coalesce(nullif(rtrim(any_value(e.title), '.'), ''), any_value(e.next_text), '') AS title, coalesce(string_agg(l.text, chr(10) ORDER BY l.line_no), '') AS text
  FROM e LEFT JOIN l ON l.doc_id = e.doc_id AND l.line_no > e.line_no AND (e.until IS NULL OR l.line_no < e.until)
  WHERE e.item IN ({", ".join(f"'{x}'" for x in KEPT_ITEMS)}) GROUP BY e.doc_id, e.item)
SELECT doc_id, section, title, length(text) AS n_chars, md5(text) AS text_md5, CASE WHEN section = '7A' AND length(text) < 500 THEN 'short_unresolved' ELSE 'own' END AS content_source, '' AS resolved_from FROM t
""",
)
def split_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sections.split_sections(_report_lines(spark, sf_dir))
    return found.select("doc_id", "section", "title", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"), "content_source", "resolved_from")


_STATEMENT_TEXT = (
    "CASE o_orderkey % 9 WHEN 0 THEN 'Consolidated Statements of Operations' WHEN 1 THEN 'CONSOLIDATED BALANCE SHEETS' WHEN 2 THEN 'Consolidated Statement of Cash Flows'"
    " WHEN 3 THEN 'Consolidated Statements of Comprehensive Income' WHEN 4 THEN 'Notes to Consolidated Financial Statements' ELSE concat('Row ', o_orderkey, ' | 2025: ', o_custkey) END"
)
_KIND = "CASE o_orderkey % 9 WHEN 0 THEN 'income' WHEN 1 THEN 'balance_sheet' WHEN 2 THEN 'cash_flow' WHEN 3 THEN '' WHEN 4 THEN '' END"


@register(
    "statement_parts",
    f"""
WITH l AS (SELECT {_DOC} AS doc_id, o_orderkey AS k, {_STATEMENT_TEXT} AS text, {_KIND} AS kind FROM orders),
c AS (SELECT *, coalesce(last_value(kind IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS going FROM l),
p AS (
  SELECT *, sum(CASE WHEN kind IS NOT NULL AND (kind <> '' OR going <> '') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS part_no,
    coalesce(kind, going) AS statement FROM c)
SELECT doc_id, CAST(part_no AS INTEGER) AS part_no, any_value(statement) AS statement, count(*) AS n_lines, md5(string_agg(text, chr(10) ORDER BY k)) AS text_md5 FROM p GROUP BY doc_id, part_no
""",
)
def statement_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.expr(_DOC).alias("doc_id"), "o_orderkey", F.expr(_STATEMENT_TEXT).alias("text"))
    eight = rows.groupBy("doc_id").agg(sections.joined_lines(F.col("o_orderkey"), F.col("text")).alias("text")).withColumn("section", F.lit("8"))
    return statements.statement_parts(eight).select("doc_id", "part_no", "statement", "n_lines", F.md5(F.col("text").cast("binary")).alias("text_md5"))


_INCOME_TEXT = "concat('Total ', o_orderstatus, ' | 2025: ', o_orderkey % 4, ' | ', o_orderpriority)"


@register(
    "scale_rows",
    f"""
WITH l AS (SELECT o_custkey AS doc_id, {_INCOME_TEXT} AS text FROM orders),
p(ord, name, label) AS (VALUES (0, 'revenue', 'Total F'), (1, 'operating_income', 'Total O'), (2, 'net_income', 'Total X')),
d AS (SELECT DISTINCT c_custkey AS doc_id FROM customer)
SELECT d.doc_id, CAST(ord AS INTEGER) AS ord, name, label, count(DISTINCT l.text) AS n_matches, min(l.text) AS row
FROM d CROSS JOIN p LEFT JOIN l ON l.doc_id = d.doc_id AND starts_with(l.text, label || ' |') GROUP BY d.doc_id, ord, name, label
""",
)
def scale_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    income = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("line_no"), F.expr(_INCOME_TEXT).alias("text"))
    pins = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit("Total F").alias("revenue_line"), F.lit("Total O").alias("operating_income_line"), F.lit("Total X").alias("net_income_line"))
    return statements.scale_matches(income, pins)


_BALANCE_TEXT = (
    "CASE o_orderkey % 8 WHEN 0 THEN 'Current assets:' WHEN 1 THEN 'Non-current assets:' WHEN 2 THEN concat('Cash and cash equivalents | 2025: ', o_orderkey % 3)"
    " WHEN 3 THEN concat('Term debt | 2025: ', o_orderkey % 5) WHEN 4 THEN 'Accounts payable | 5' WHEN 5 THEN '(In millions)' WHEN 6 THEN 'Commercial paper was issued.'"
    " ELSE concat('Marketable securities | 2025: ', o_orderkey % 2) END"
)


@register(
    "cash_debt_lines",
    f"""
WITH l AS (SELECT o_custkey AS doc_id, o_orderkey AS line_no, o_orderkey % 8 AS m, {_BALANCE_TEXT} AS text FROM orders),
f AS (SELECT *, m IN (2, 3, 7) AND line_no = min(line_no) OVER (PARTITION BY doc_id, text) AS is_row FROM l),
c AS (
  SELECT *, max(CASE WHEN m IN (0, 1) THEN line_no END) OVER w AS head_no, min(CASE WHEN is_row THEN line_no END) OVER (PARTITION BY doc_id) AS first_row,
    min(CASE WHEN m = 5 THEN line_no END) OVER (PARTITION BY doc_id) AS units_no
  FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
o AS (SELECT *, min(CASE WHEN is_row THEN line_no END) OVER (PARTITION BY doc_id, head_no) AS opener FROM c)
SELECT doc_id, line_no, 1 AS part, text FROM o WHERE is_row OR (m = 5 AND line_no = units_no AND (first_row IS NULL OR line_no < first_row))
UNION ALL
SELECT o.doc_id, o.line_no, 0, h.text FROM o JOIN l h ON h.doc_id = o.doc_id AND h.line_no = o.head_no WHERE o.is_row AND o.line_no = o.opener
""",
)
def cash_debt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("line_no"), F.expr(_BALANCE_TEXT).alias("text"))
    return statements.cash_debt_lines(balance)


_STRIDE = """
n AS (SELECT *, greatest(CAST(ceil((length(text) - 150) / 850.0) AS BIGINT) - 1, 0) AS last FROM documents WHERE length(text) > 0),
ch AS (SELECT doc_id, lang, source, CAST(i AS INTEGER) AS chunk_index, substring(text, i * 850 + 1, 1000) AS text FROM (SELECT *, unnest(range(0, last + 1)) AS i FROM n))
"""


@register("fixed_stride_chunks", f"WITH {_STRIDE} SELECT doc_id, chunk_index, length(text) AS n_chars, md5(text) AS text_md5 FROM ch")
def fixed_stride_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = chunking.fixed_stride_chunks(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "chunk_index", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@register(
    "chunk_counts_pivot",
    f"""WITH {_STRIDE} SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'es') AS es,
  count(*) FILTER (lang IS NULL OR lang NOT IN ('en', 'de', 'fr', 'es')) AS other, count(*) AS total FROM ch GROUP BY source""",
)
def chunk_counts_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.filter(F.length("text") > 0).select("source", "lang", F.explode(chunking.stride_chunks(F.col("text"))).alias("text"))
    return chunking.chunk_counts(rows, "source", "lang", ("en", "de", "fr", "es"))


@register("recursive_chunks")
def recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.recursive_chunks(table(spark, sf_dir, "documents"))


@register("page_lines")
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_lines.html_lines(table(spark, sf_dir, "pages"), "page_id")
