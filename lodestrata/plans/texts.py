"""Queries of citations, figures, labels and contexts. The texts are conversations, and orders told in sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import citations, figures, labels
from lodestrata.functions.limits import rate_limit_message
from lodestrata.functions.text import html_escape
from lodestrata.operators.answers import gathered, marked_passages
from lodestrata.plans.registry import register, table

_CITED = "concat(text, ' [', turn, ', ', conv_id % 7, '] and 【', turn + 1, '†L1-L3】 but not [a', turn, '].')"
_CITATION_SQL = r"[\[【](\d+(?:\s*,\s*\d+)*)(?:†[^\]】]*)?[\]】]"


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_CITED).alias("answer"))


@register("citations_displayed", f"SELECT conv_id, turn, md5(regexp_replace({_CITED}, '{_CITATION_SQL}', '[\\1]', 'g')) AS shown_md5 FROM conversations")
def citations_displayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cited(spark, sf_dir).select("conv_id", "turn", F.md5(citations.display_citations(F.col("answer")).cast("binary")).alias("shown_md5"))


@register(
    "citation_numbers",
    f"""
WITH a AS (SELECT conv_id, turn, regexp_extract_all({_CITED}, '{_CITATION_SQL}', 1) AS groups FROM conversations),
e AS (SELECT conv_id, turn, unnest(string_split(regexp_replace(array_to_string(groups, ','), '\\s', '', 'g'), ',')) AS n, generate_subscripts(string_split(array_to_string(groups, ','), ','), 1) AS i FROM a WHERE len(groups) > 0),
f AS (SELECT conv_id, turn, n, min(i) AS i FROM e GROUP BY ALL)
SELECT conv_id, turn, string_agg(n, ',' ORDER BY i) AS cited FROM f GROUP BY conv_id, turn
""",
)
def citation_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cited(spark, sf_dir).select("conv_id", "turn", F.array_join(citations.cited_numbers(F.col("answer")), ",").alias("cited"))


#: An order as an answer: an amount, a percentage, an approximate multiple, a plain year and a count.
_PRICE = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS {s})"
_ANSWER = (
    "concat('In 2024 sales were $', {p}, ' million [1], up ', o_custkey % 90, '.5% in Item 7; debt is ≈ ', o_orderkey % 9 + 1, '.5x cash [2]【3†L2】, ',"
    " o_orderkey + 3000, ' units and ', o_orderkey % 90 + 10, ' sites.')"
)
_SAID = _ANSWER.format(p=_PRICE.format(s="STRING"))
_FIGURES = "concat('$', {p}), concat(o_custkey % 90, '.5%'), concat(o_orderkey % 9 + 1, '.5x'), concat(o_orderkey + 3000)"
_PRICE_SQL = _PRICE.format(s="VARCHAR")


@register("figures_extracted", f"SELECT o_orderkey, array_to_string(list_distinct_ordered, ';') AS figures FROM (SELECT o_orderkey, [{_FIGURES.format(p=_PRICE_SQL)}] AS list_distinct_ordered FROM orders)")
def figures_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(figures.answer_figures(F.expr(_SAID)), ";").alias("figures"))


@register(
    "answer_checks",
    f"""
WITH a AS (SELECT o_orderkey, o_custkey, {_PRICE_SQL} AS p, CAST(o_orderkey % 2 AS INTEGER) AS odd FROM orders)
SELECT o_orderkey, '1,2,3' AS cited, '3' AS invalid_citations,
  array_to_string(list_filter([CASE WHEN odd = 1 THEN concat('$', p) END, concat(o_custkey % 90, '.5%')], lambda x: x IS NOT NULL), ';') AS unverified_figures,
  concat('≈ ', o_orderkey % 9 + 1, '.5x') AS approximate_ratios
FROM a
""",
)
def answer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Even orders' prices are in a cited passage (padded with zeros, to be equal in value only); all counts are.
    price = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.expr(_PRICE.format(s="STRING")), F.lit("00"))).otherwise(F.lit("none"))
    first = F.struct(F.lit(1).alias("n"), F.concat(F.lit("Sales | 2024: "), price).alias("text"))
    second = F.struct(F.lit(2).alias("n"), F.concat(F.lit("Units "), F.format_number(F.col("o_orderkey") + 3000, 0)).alias("text"))
    check = figures.check_answer(F.expr(_SAID), F.array(first, second), True)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", check.alias("c"))
    return rows.select("o_orderkey", *[F.array_join(F.col(f"c.{x}").cast("array<string>"), s).alias(x) for x, s in (("cited", ","), ("invalid_citations", ","), ("unverified_figures", ";"), ("approximate_ratios", ";"))])


_LABEL_SQL = "concat(s_name, ' · 10-K FY', 2000 + s_suppkey % 25, ' · Item ', CASE WHEN s_suppkey % 3 = 0 THEN '7A (Item 7, Market Risk)' ELSE '8' END, CASE WHEN s_suppkey % 3 = 1 THEN ' · Income statement' WHEN s_suppkey % 3 = 2 THEN ' · Cash flow statement' ELSE '' END)"


@register("passage_labels", f"SELECT s_suppkey, {_LABEL_SQL} AS label FROM supplier")
def passage_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    pointer = F.col("s_suppkey") % 3 == 0
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        labels.passage_label(
            F.col("s_name"), F.lit("10-K"), F.lit(2000) + F.col("s_suppkey") % 25, F.when(pointer, "7A").otherwise("8"), F.when(pointer, "Item 7, Market Risk").otherwise(""),
            F.when(pointer, "").when(F.col("s_suppkey") % 3 == 1, "income").otherwise("cash_flow"),
        ).alias("label"),
    )


def _retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("n"), "text", F.col("role").alias("section"))
    return own.withColumns({"company": F.lit("Talk"), "form": F.lit("10-K"), "fiscal_year": F.lit(2025)})


_CONTEXT_SQL = "string_agg(concat('[', turn + 1, '] Talk · 10-K FY2025 · Item ', role, chr(10), text), chr(10) || chr(10) ORDER BY turn)"


@register("numbered_contexts", f"SELECT conv_id, md5({_CONTEXT_SQL}) AS context_md5 FROM conversations GROUP BY conv_id")
def numbered_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gathered(_retrieved(spark, sf_dir), ["conv_id"])
    return found.select("conv_id", F.md5(labels.numbered_context(F.col("passages")).cast("binary")).alias("context_md5"))


@register("passages_cited", "SELECT conv_id, count(*) AS passages, string_agg(CASE WHEN (turn + 1) IN (2, 3) THEN CAST(turn + 1 AS VARCHAR) END, ',' ORDER BY turn) AS cited FROM conversations GROUP BY conv_id")
def passages_cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gathered(_retrieved(spark, sf_dir), ["conv_id"]).withColumn("p", marked_passages(F.col("passages"), F.lit("As said [3] and [2].")))
    shown = F.array_join(F.transform(F.filter("p", lambda x: x["cited"]), lambda x: x["n"].cast("string")), ",")
    return found.select("conv_id", F.size("p").cast("long").alias("passages"), F.nullif(shown, F.lit("")).alias("cited"))


@register("html_escaped", "SELECT conv_id, turn, md5(replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;'), '$', '&#36;')) AS html_md5 FROM conversations")
def html_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(html_escape(F.col("text")).cast("binary")).alias("html_md5"))


_LIMIT = "concat('Rate limit reached on tokens per ', CASE WHEN o_orderkey % 2 = 0 THEN 'day (TPD)' ELSE 'minute (TPM)' END, CASE WHEN o_orderkey % 3 = 0 THEN concat('. Please try again in ', o_orderkey % 50, 'm', o_custkey % 60, '.79s. Need more?') ELSE '' END)"


@register(
    "rate_limit_messages",
    """
SELECT o_orderkey, concat(CASE WHEN o_orderkey % 2 = 0 THEN 'The model service allows no more calls today: its daily quota is used up.'
  ELSE 'The model service is asked too often at the moment and refuses calls for a while.' END,
  CASE WHEN o_orderkey % 3 = 0 THEN concat(' Try again in about ', o_orderkey % 50, 'm', o_custkey % 60, 's.') ELSE '' END) AS message FROM orders
""",
)
def rate_limit_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", rate_limit_message(F.expr(_LIMIT)).alias("message"))
