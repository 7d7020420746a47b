"""Queries of replies, scores and prompts. Orders stand for a model's replies: a customer is a company."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import reasons, rubric
from lodestrata.functions.presentation import dashboard_status, risk_card
from lodestrata.functions.replies import parse_reply
from lodestrata.operators import prompts
from lodestrata.operators.scoring import overall_scores
from lodestrata.plans.registry import register, table


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SCORE = "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 10 + 1 AS INTEGER) END"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ticker"), F.col("o_orderkey").alias("category"), F.expr(_SCORE).alias("score"))


@register("risk_levels", f"SELECT o_orderkey, s AS score, CASE WHEN s < 4 THEN 'Low' WHEN s < 7 THEN 'Medium' WHEN s IS NOT NULL THEN 'High' END AS level FROM (SELECT o_orderkey, {_SCORE} AS s FROM orders)")
def risk_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select(F.col("category").alias("o_orderkey"), "score", rubric.risk_level(F.col("score")).alias("level"))


_OVERALL_SQL = f"""
s AS (SELECT o_custkey AS ticker, {_SCORE} AS score FROM orders),
g AS (SELECT ticker, CASE WHEN count(score) >= 4 THEN CAST(round_even(sum(score) / (10.0::DOUBLE * count(score)) * 100, 0) AS INTEGER) END AS overall, count(score) AS scored, count(*) AS categories FROM s GROUP BY ticker)
"""


@register("overall_scores", f"WITH {_OVERALL_SQL} SELECT ticker, overall, CASE WHEN overall < 40 THEN 'Low' WHEN overall < 70 THEN 'Medium' WHEN overall IS NOT NULL THEN 'High' END AS level, scored, categories FROM g")
def overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overall_scores(_scores(spark, sf_dir))


@register(
    "dashboard_status",
    f"""WITH {_OVERALL_SQL} SELECT ticker, CASE WHEN overall IS NULL THEN concat('No overall score: only ', scored, ' of ', categories, ' categories could be scored (at least 4 needed).')
  WHEN scored < categories THEN concat(categories - scored, ' of ', categories, ' categories could not be scored and are left out of the overall score.') END AS status FROM g""",
)
def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overall_scores(_scores(spark, sf_dir)).select("ticker", dashboard_status(F.col("overall"), F.col("scored"), F.col("categories")).alias("status"))


#: Replies of many forms, n being the order's key.
_REPLIES = [
    "concat('SCORE: ', n % 10 + 1, '  ', chr(10), 'REASON: Strong cash of $', n, ' million.')",
    "concat('**SCORE:** [', n % 10 + 1, ']', chr(10), '**REASON:** High litigation ', n)",
    "concat('score: ', n % 10 + 1, '/10', chr(10), 'reason:   x ', n, '   ')",
    "concat('SCORE: ', n % 10 + 1, '.5', chr(10), 'REASON: x')",
    "concat('SCORE: ', n + 11, chr(10), 'REASON: x')",
    "concat('SCORE: insufficient', chr(10), 'REASON: only ', n)",
    "concat('Overall the SCORE: 5 seems fair ', n)",
    "concat('SCORE: ', n % 10 + 1)",
    "'SCORE: INSUFFICIENT'",
]


_REPLY = f"CASE n % {len(_REPLIES)} " + " ".join(f"WHEN {i} THEN {r}" for i, r in enumerate(_REPLIES)) + " END"


@register(
    "score_replies",
    f"""
WITH r AS (SELECT n, replace({_REPLY}, '*', '') AS t FROM (SELECT o_orderkey AS n FROM orders)),
m AS (
  SELECT n, TRY_CAST(regexp_extract(t, '(?im)^\\s*SCORE\\s*:\\s*\\[?\\s*([0-9]+)', 1) AS INTEGER) AS s, regexp_matches(t, '(?im)^\\s*SCORE\\s*:\\s*\\[?\\s*[0-9]+\\.[0-9]') AS broken,
    regexp_matches(t, '(?im)^\\s*SCORE\\s*:\\s*\\[?\\s*INSUFFICIENT\\b') AS lacking,
    CASE WHEN regexp_matches(t, '(?im)^\\s*REASON\\s*:\\s*.') THEN trim(regexp_extract(t, '(?im)^\\s*REASON\\s*:\\s*(.+)$', 1)) ELSE 'No reason given' END AS why FROM r)
SELECT n AS o_orderkey, CASE WHEN NOT lacking AND NOT broken AND s BETWEEN 1 AND 10 THEN s END AS score,
  CASE WHEN lacking THEN concat('Insufficient information: ', why) WHEN NOT broken AND s BETWEEN 1 AND 10 THEN why ELSE 'Could not parse model response' END AS reason FROM m
""",
)
def score_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n")).select("n", parse_reply(F.expr(_REPLY.replace("chr(10)", "'\\n'"))).alias("r"))
    return rows.select(F.col("n").alias("o_orderkey"), "r.score", "r.reason")


#: case -> (reason, short reason).
_REASONS = [
    ("concat('Reach: ', n, '.1% of sales is made outside the E.U. [2][1]. Cover: nominal $9 million [3].')", "concat('Reach: ', n, '.1% of sales is made outside the E.U.')"),
    ("concat('Deposits of $', n, ' million meet ≈31% of it (passages [2] and [3]); loans meet the rest [4].')", "concat('Deposits of $', n, ' million meet ≈31% of it')"),
    ("concat('The company reports $', n, ' million in net revenues and $11 million net earnings (2025) [1]; it names ', n, ' ports [3].')", "concat('It names ', n, ' ports')"),
    ("concat('Net earnings were $', n, ' million [1].')", "concat('Net earnings were $', n, ' million')"),
    ("concat('loans of $6.12 billion ', repeat(concat(n, ' word '), 20), 'end.')", "concat('Loans of $6.12 billion', repeat(concat(' ', n, ' word'), 8), '…')"),
]


def _reason_case(part: int) -> str:
    return f"CASE n % {len(_REASONS)} " + " ".join(f"WHEN {i} THEN {r[part]}" for i, r in enumerate(_REASONS)) + " END"


@register("short_reasons", f"SELECT n AS o_orderkey, {_reason_case(1)} AS line FROM (SELECT o_orderkey AS n FROM orders)")
def short_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n"))
    return rows.select(F.col("n").alias("o_orderkey"), reasons.short_reason(F.expr(_reason_case(0))).alias("line"))


@register("rubric_texts", "SELECT category, text FROM (VALUES " + ", ".join(f"({_quoted(c)}, {_quoted(t)})" for c, t in rubric.rubric_texts().items()) + ") AS t(category, text)")
def rubric_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joined up from the table of bands; the SQL has the texts as the prompt gets them."""
    bands = rubric.bands_table(spark).select("category", "low", F.concat(F.col("low").cast("string"), F.lit("-"), F.col("high").cast("string"), F.lit(": "), "description").alias("line"))
    lines = bands.groupBy("category").agg(F.transform(F.sort_array(F.collect_list(F.struct("low", "line"))), lambda b: b["line"]).alias("lines"))
    notes = spark.createDataFrame(list(rubric.NOTES.items()), "category string, note string")
    return lines.join(notes, "category", "left").select("category", F.concat_ws("\n", "lines", "note").alias("text"))


def _sql_prompt(template: str, **values: str) -> str:
    """The template as a DuckDB expression."""
    parts, rest = [], template
    while "{" in rest:
        before, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [_quoted(before), values[name]]
    return f"concat({', '.join([*parts, _quoted(rest)])})"


@register("answer_prompts", f"SELECT conv_id, turn, md5({_sql_prompt(prompts.ANSWER_TEMPLATE, context='text', question='role')}) AS prompt_md5 FROM conversations")
def answer_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.md5(prompts.answer_prompt(F.col("text"), F.col("role")).cast("binary")).alias("prompt_md5"))


_CATEGORY = f"CASE conv_id % 2 WHEN 0 THEN 'FX Risk' ELSE 'Legal Risk' END"
_SCORE_PROMPT_SQL = _sql_prompt(
    prompts.SCORE_TEMPLATE, category=_CATEGORY, general=_quoted(rubric.GENERAL_RULE), context="text",
    rubric=f"CASE conv_id % 2 WHEN 0 THEN {_quoted(rubric.rubric_texts()['FX Risk'])} ELSE {_quoted(rubric.rubric_texts()['Legal Risk'])} END",
    fixed=f"concat({_quoted(prompts.FIXED_SCALE)}, CASE WHEN turn % 2 = 0 THEN {_quoted(prompts.FIXED_BALANCE)} ELSE '' END)",
    form=f"CASE conv_id % 2 WHEN 0 THEN {_quoted(prompts.REASON_FORM_FX)} ELSE {_quoted(prompts.REASON_FORM)} END",
)


@register("score_prompts", f"SELECT conv_id, turn, md5({_SCORE_PROMPT_SQL}) AS prompt_md5 FROM conversations")
def score_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    prompt = prompts.score_prompt(F.expr(_CATEGORY), F.col("text"), F.col("turn") % 2 == 0)
    return rows.select("conv_id", "turn", F.md5(prompt.cast("binary")).alias("prompt_md5"))


_CARD_SQL = (
    "concat('<div class=\"risk-card ', CASE WHEN s IS NULL THEN 'na-risk' WHEN s < 4 THEN 'low-risk' WHEN s < 7 THEN 'medium-risk' ELSE 'high-risk' END, '\"><div class=\"card-head\"><span>FX</span><span class=\"card-score\">',"
    " CASE WHEN s IS NULL THEN 'n/a' ELSE concat(s, '/10 · ', CASE WHEN s < 4 THEN 'Low' WHEN s < 7 THEN 'Medium' ELSE 'High' END) END, '</span></div><div class=\"card-line\">Sales fell &lt; &#36;', o_orderkey, ' million</div></div>')"
)


@register("risk_cards", f"SELECT o_orderkey, {_CARD_SQL} AS card FROM (SELECT o_orderkey, {_SCORE} AS s FROM orders)")
def risk_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.concat(F.lit("sales fell < $"), F.col("category").cast("string"), F.lit(" million [1]."))
    return _scores(spark, sf_dir).select(F.col("category").alias("o_orderkey"), risk_card(F.lit("FX Risk"), F.col("score"), reason).alias("card"))
