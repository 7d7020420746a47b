"""Queries of facts, ratios and fact sheets. A nation is a company; its customers give the amounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import facts as shown
from lodestrata.operators import factsheets
from lodestrata.plans.registry import register, table
from lodestrata.sources.labels import label_template


@register(
    "number_texts",
    """
WITH v AS (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS a, CAST(o_orderkey AS DOUBLE) / 400 AS r FROM orders)
SELECT o_orderkey, CASE WHEN a = round_even(a, 0) THEN format('{:,.0f}', a) ELSE format('{:,.2f}', a) END AS amount,
  CASE WHEN r >= 1 THEN format('{:.1f}×', r) WHEN r < 0.01 THEN format('{:.2f}%', 100 * r) ELSE format('{:.1f}%', 100 * r) END AS ratio FROM v
""",
)
def number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    return rows.select("o_orderkey", shown.number_text(F.col("o_totalprice")).alias("amount"), shown.ratio_text(F.col("o_orderkey").cast("double") / 400).alias("ratio"))


_PART_TEXT = "concat('Part ', p_name, ' | price: ', p_size)"


def _facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Brands as companies: a line for each part, and a fact quoting each part's name and size."""
    part = table(spark, sf_dir, "part")
    lines = part.select(F.col("p_brand").alias("ticker"), F.lit("8").alias("section"), F.when(F.col("p_partkey") % 2 == 0, "income").otherwise("").alias("statement"), F.expr(_PART_TEXT).alias("text"))
    facts = part.select(
        F.col("p_brand").alias("ticker"), F.col("p_partkey").alias("ord"), F.col("p_partkey").cast("string").alias("id"), F.lit("scale").alias("topic"), F.col("p_name").alias("label"), F.lit("8").alias("section"),
        F.when(F.col("p_partkey") % 3 == 0, "income").alias("statement"), F.concat(F.col("p_name"), F.lit(" | price: "), F.col("p_size").cast("string")).alias("quote"),
        F.when(F.col("p_partkey") % 5 == 0, "x").otherwise(F.col("p_size").cast("string")).alias("value"), F.when(F.col("p_partkey") % 2 == 0, "billions").otherwise("millions").alias("unit"),
    )
    return lines, facts


_FACTS_SQL = f"""
l AS (SELECT p_brand AS ticker, CASE WHEN p_partkey % 2 = 0 THEN 'income' ELSE '' END AS statement, {_PART_TEXT} AS text FROM part),
f AS (
  SELECT p_brand AS ticker, CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 3 = 0 THEN 'income' END AS statement, concat(p_name, ' | price: ', p_size) AS quote,
    CASE WHEN p_partkey % 5 = 0 THEN 'x' ELSE CAST(p_size AS VARCHAR) END AS value FROM part),
q AS (
  SELECT f.ticker, f.id, f.statement, f.quote, f.value, count(DISTINCT l.text) AS n_lines FROM f
  LEFT JOIN l ON l.ticker = f.ticker AND (f.statement IS NULL OR f.statement = l.statement) AND contains(l.text, f.quote) GROUP BY ALL)
"""


@register("quote_lines", f"WITH {_FACTS_SQL} SELECT ticker, id, n_lines FROM q")
def quote_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factsheets.quote_lines(*_facts(spark, sf_dir))


@register(
    "fact_problems",
    f"""WITH {_FACTS_SQL}, p AS (SELECT ticker, id, CASE WHEN n_lines <> 1 THEN concat('quote found on ', n_lines, ' distinct lines of Item 8', CASE WHEN statement IS NULL THEN '' ELSE ' ' || statement END)
  WHEN NOT contains(quote, value) THEN concat('value ', value, ' is not in the quote') END AS problem FROM q) SELECT * FROM p WHERE problem IS NOT NULL""",
)
def fact_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factsheets.fact_problems(*_facts(spark, sf_dir))


@register("fact_values", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size * 1000.0::DOUBLE WHEN 1 THEN p_size * 1.0::DOUBLE END AS amount FROM part")
def fact_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.when(F.col("p_partkey") % 3 == 0, "billions").when(F.col("p_partkey") % 3 == 1, "millions").otherwise("percent")
    return table(spark, sf_dir, "part").select("p_partkey", shown.fact_value(F.col("p_size").cast("string"), unit).alias("amount"))


_AMOUNTS_SQL = """
v AS (SELECT CAST(c_nationkey AS VARCHAR) AS ticker, CAST(count(*) AS DOUBLE) AS a, CAST(count(*) FILTER (c_mktsegment = 'BUILDING') AS DOUBLE) AS b, CAST(count(DISTINCT c_mktsegment) AS DOUBLE) AS c FROM customer GROUP BY 1)
"""


def _amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("string").alias("ticker")).agg(
        F.count("*").cast("double").alias("a"), F.count_if(F.col("c_mktsegment") == "BUILDING").cast("double").alias("b"), F.count_distinct("c_mktsegment").cast("double").alias("c")
    )
    return found.select("ticker", F.inline(F.array(*[F.struct(F.lit(x).alias("id"), F.col(x).alias("amount")) for x in "abc"])))


@register(
    "fact_ratios",
    f"""
WITH {_AMOUNTS_SQL},
r AS (
  SELECT ticker, 'share' AS label, format('({{:,.0f}} - {{:,.0f}}) / {{:,.0f}}', a, b, a) AS formula, (a - b) / a AS ratio FROM v
  UNION ALL SELECT ticker, 'multiple', format('{{:,.0f}} / {{:,.0f}}', a, c), a / c FROM v
  UNION ALL SELECT ticker, 'gone', NULL, NULL FROM v)
SELECT ticker, label, formula, round(ratio, 9) AS ratio, CASE WHEN ratio >= 1 THEN format('{{:.1f}}×', ratio) WHEN ratio < 0.01 THEN format('{{:.2f}}%', 100 * ratio) WHEN ratio IS NOT NULL THEN format('{{:.1f}}%', 100 * ratio) END AS shown,
  CASE label WHEN 'gone' THEN 'zzz' ELSE '' END AS missing FROM r
""",
)
def fact_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _amounts(spark, sf_dir)
    wanted = [("share", ["a", "-b"], ["a"]), ("multiple", ["a"], ["c"]), ("gone", ["a", "zzz"], ["b"])]
    terms = lambda names: F.array(*map(F.lit, names))
    specs = F.array(*[F.struct(F.lit(name).alias("label"), terms(up).alias("numerator"), terms(down).alias("denominator")) for name, up, down in wanted])
    ratios = values.select("ticker").distinct().select("ticker", F.inline(specs))
    found = factsheets.ratio_values(ratios, values)
    return found.select("ticker", "label", "formula", F.round("ratio", 9).alias("ratio"), "shown", F.array_join("missing", ",").alias("missing"))


@register(
    "label_template",
    "SELECT n_name AS company, c.i AS cat_ord, c.category, '' AS my_score, '' AS my_reason FROM nation CROSS JOIN (VALUES (0, 'FX Risk'), (1, 'Interest Rate Risk'), (2, 'Liquidity Risk'), (3, 'Revenue Risk'), (4, 'Legal Risk'), (5, 'Operational Risk')) AS c(i, category)",
)
def template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_template(table(spark, sf_dir, "nation").select(F.col("n_name").alias("ticker")))


@register(
    "fact_sheets",
    """
WITH n AS (SELECT n_nationkey AS k, n_name, n_regionkey FROM nation)
SELECT n_name AS ticker, md5(concat('# Company ', k, ' (', n_name, ') · 10-K FY2025', chr(10), chr(10), 'Fact sheet. Filing: [acc-', k, '](https://example.org/', k, '), period ended 2025-12-31.', chr(10),
  'Facts are quoted from the parsed filing, each checked to stand on one line of it; ratios are worked out from the quoted values, in $ millions.', chr(10), chr(10),
  '## Scale (income statement)', chr(10), chr(10), '- **Revenue**: “Revenue | 2025: ', k + 1000, '” (Item 8 · Income statement)', chr(10), '- **Debt**: “Debt of $', k + 10, ' million” (Item 7A (Item 7, Market Risk))', chr(10),
  chr(10), '| Computed ratio | Formula ($ millions) | Value |', chr(10), '|---|---|---|', chr(10), '| Debt / revenue | ', k + 10, ' / ', format('{:,}', k + 1000), ' | ', format('{:.1f}%', 100.0::DOUBLE * (k + 10) / (k + 1000)), ' |', chr(10), chr(10),
  '## FX risk', chr(10), chr(10), '', chr(10), '## Interest rate risk', chr(10), chr(10), '', chr(10), '## Notes', chr(10), chr(10), '- Region ', n_regionkey, chr(10), '')) AS sheet_md5 FROM n
""",
)
def fact_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("ticker"), F.col("n_nationkey").alias("k"), "n_regionkey")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    k = F.col("k")
    pins = n.select("ticker", text("Company ", k).alias("company"), F.lit("10-K").alias("form"), F.lit(2025).alias("fiscal_year"), text("acc-", k).alias("accession"), text("https://example.org/", k).alias("source_url"), F.lit("2025-12-31").alias("period_end"))
    fact = lambda i, name, label, section, statement, quote, value: F.struct(F.lit(i).alias("ord"), F.lit(name).alias("id"), F.lit("scale").alias("topic"), F.lit(label).alias("label"), F.lit(section).alias("section"), F.lit(statement).cast("string").alias("statement"), quote.alias("quote"), value.cast("string").alias("value"), F.lit("millions").alias("unit"))
    facts = n.select("ticker", F.inline(F.array(fact(0, "revenue", "Revenue", "8", "income", text("Revenue | 2025: ", k + 1000), k + 1000), fact(1, "debt", "Debt", "7A", None, text("Debt of $", k + 10, " million"), k + 10))))
    ratios = n.select("ticker", F.lit(0).alias("ord"), F.lit("scale").alias("topic"), F.lit("Debt / revenue").alias("label"), F.array(F.lit("debt")).alias("numerator"), F.array(F.lit("revenue")).alias("denominator"))
    notes = n.select("ticker", F.lit(0).alias("ord"), text("Region ", F.col("n_regionkey")).alias("note"))
    sections = n.select("ticker", F.inline(F.array(F.struct(F.lit("8").alias("section"), F.lit("").alias("resolved_from")), F.struct(F.lit("7A").alias("section"), F.lit("Item 7, Market Risk").alias("resolved_from")))))
    made = factsheets.sheets(pins, sections, facts, ratios, notes)
    return made.select("ticker", F.md5(F.col("sheet").cast("binary")).alias("sheet_md5"))
