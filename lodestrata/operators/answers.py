"""Passages, answers and their checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.citations import cited_numbers
from lodestrata.functions.figures import check_answer
from lodestrata.functions.labels import numbered_context, passage_label
from lodestrata.operators.completion import Client, complete
from lodestrata.operators.prompts import answer_prompt
from lodestrata.operators.retrieval import retrieve_for_questions

SOURCE_FIELDS = ("company", "form", "fiscal_year", "section", "section_title", "resolved_from", "accession", "source_url")


def passage_struct(retrieved: DataFrame) -> Column:
    """A retrieved chunk as a numbered, labelled passage; fields that are missing or null are empty."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in retrieved.columns else F.lit("")
    label = passage_label(*map(named, ("company", "form", "fiscal_year", "section", "resolved_from", "statement")))
    return F.struct(F.col("n").cast("int").alias("n"), label.alias("label"), F.col("text"), *[named(c).alias(c) for c in SOURCE_FIELDS])


def gathered(retrieved: DataFrame, by: list[str]) -> DataFrame:
    """by, passages: an array in order of n. Groups are bounded by the quotas and the statements of one filing."""
    return retrieved.select(*by, passage_struct(retrieved).alias("_p")).groupBy(*by).agg(F.sort_array(F.collect_list("_p")).alias("passages"))


def marked_passages(passages: Column, answer: Column) -> Column:
    """The passages, each with `cited`: whether the answer cites it."""
    cited = cited_numbers(answer)
    return F.transform(passages, lambda p: p.withField("cited", F.array_contains(cited, p["n"].cast("long"))))


def ask(chunks: DataFrame, questions: DataFrame, client: Callable[[], Client]) -> DataFrame:
    """question_id, answer, passages (with cited) and check for each of questions (question_id, ticker, question, vector)."""
    found = gathered(retrieve_for_questions(chunks, questions), ["question_id"])
    asked = questions.select("question_id", "question").join(found, "question_id")
    prompted = asked.withColumn("prompt", answer_prompt(numbered_context(F.col("passages")), F.col("question")))
    replied = complete(prompted, client, None).withColumnRenamed("reply", "answer")
    marked = replied.withColumn("passages", marked_passages(F.col("passages"), F.col("answer")))
    return marked.select("question_id", "answer", "passages", check_answer(F.col("answer"), F.col("passages")).alias("check"))
