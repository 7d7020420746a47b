"""Prompts: templates with marks that columns are put in for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.functions.rubric import GENERAL_RULE, rubric_text

ANSWER_TEMPLATE = """You help financial analysts. Answer from the numbered passages below and from nothing else.

Rules:
- State figures exactly as the passages do; never compute one from others, not even rounded. Say so if a figure is not there.
- Where several years are covered, give each figure with its fiscal year.
- Net income means the amount attributable to the company (its common stockholders or shareowners). A plain net income line that includes noncontrolling interests may only be added as a second, labelled figure.
- Take headline figures (total revenue, net income) from a passage labelled "Income statement" if there is one, never from notes on investees, segments or related parties.
- Cite the passage after each figure and statement, as [2] or [1, 3]; cite only numbers that are given.
- If the passages hold no answer, say: I could not find this information in the document.

Passages:
{context}

Question: {question}

Answer clearly and in order, with figures where there are any."""

SCORE_TEMPLATE = """You rate one risk of a company from 1 to 10: {category}.

{general}

Rubric:
{rubric}

Passages ({fixed}):
{context}

Rules:
- Use amounts exactly as stated. A ratio that you work out yourself is marked with ≈ before it, as in ≈ 2% or ≈ 2.9x.
- Cite the passage after each fact, as [n]; cite only numbers that are given.
- The reason is one line.

Reply in exactly this form:
SCORE: [a whole number from 1 to 10, or INSUFFICIENT]
REASON: {form}"""

SUMMARY_TEMPLATE = """You advise on risk. A company's scores by category:
{scores}
Overall: {overall} of 100

From its filing:
{context}

Sum up its risk profile in three sentences, with figures from the text."""

FIXED_SCALE = "[1] is the company's scale, from its income statement"
FIXED_BALANCE = "; [2] is its cash, investments and debt, from its balance sheet"
REASON_FORM = "one or two sentences, each fact cited as [n]"
REASON_FORM_FX = "Gross exposure: facts, each cited as [n]. Hedging: facts, each cited as [n]."


def filled(template: str, **values: Column) -> Column:
    """The template with each {name} replaced; the values are put in from left to right and never searched."""
    parts, rest = [], template
    while "{" in rest:
        before, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(before), values[name]]
    return F.concat(*parts, F.lit(rest))


def answer_prompt(context: Column, question: Column) -> Column:
    return filled(ANSWER_TEMPLATE, context=context, question=question)


def score_prompt(category: Column, context: Column, with_balance_sheet: Column) -> Column:
    fixed = F.concat(F.lit(FIXED_SCALE), F.when(with_balance_sheet, FIXED_BALANCE).otherwise(""))
    form = F.when(category == "FX Risk", REASON_FORM_FX).otherwise(REASON_FORM)
    return filled(SCORE_TEMPLATE, category=category, general=F.lit(GENERAL_RULE), rubric=rubric_text(category), fixed=fixed, context=context, form=form)


def summary_prompt(scores: Column, overall: Column, context: Column) -> Column:
    return filled(SUMMARY_TEMPLATE, scores=scores, overall=overall.cast("string"), context=context)
