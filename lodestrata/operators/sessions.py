"""Turns of a conversation and the state of a filing's analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def next_turns(history: DataFrame, answered: DataFrame, session: str = "session_id") -> DataFrame:
    """The rows to append to history (session, turn, role, content, ...) for answered questions (session, question,
    answer, passages, check): a user's turn and an assistant's, after the last turn. Questions without an
    answer add nothing, so that a refused call leaves the history as it was."""
    last = history.groupBy(session).agg(F.max("turn").alias("_last"))
    done = answered.filter(F.col("answer").isNotNull()).join(last, session, "left").withColumn("_last", F.coalesce("_last", F.lit(-1)))
    order = F.row_number().over(Window.partitionBy(session).orderBy("question"))
    numbered = done.withColumn("_first", F.col("_last") + 2 * order - 1)
    user = F.struct(F.lit("user").alias("role"), F.col("question").alias("content"), F.lit(0).alias("_i"))
    assistant = F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content"), F.lit(1).alias("_i"))
    each = numbered.select(session, "_first", "passages", "check", F.inline(F.array(user, assistant)))
    own = F.col("_i") == 1
    return each.select(session, (F.col("_first") + F.col("_i")).cast("long").alias("turn"), "role", "content", F.when(own, F.col("passages")).alias("passages"), F.when(own, F.col("check")).alias("check"))


def split_by_citation(passages: Column) -> Column:
    """struct<cited, others> of passages marked with `cited`."""
    return F.struct(F.filter(passages, lambda p: p["cited"]).alias("cited"), F.filter(passages, lambda p: ~p["cited"]).alias("others"))


def check_warnings(check: Column) -> Column:
    """array<string>: what is wrong with an answer's citations and figures; empty if nothing is."""
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ", ")
    none = F.array().cast("array<string>")
    found = F.concat(
        F.when(F.size(check["invalid_citations"]) > 0, F.array(F.concat(F.lit("Cites passages that are not there: "), listed(check["invalid_citations"])))).otherwise(none),
        F.when(F.size(check["unverified_figures"]) > 0, F.array(F.concat(F.lit("Figures found in no cited passage: "), listed(check["unverified_figures"])))).otherwise(none),
    )
    return F.coalesce(found, none)


def ready_filings(pins: DataFrame, chunks: DataFrame, results: DataFrame) -> DataFrame:
    """The pins whose ticker has chunks, each with `analysed`: whether a result is kept for its accession."""
    kept = results.select("ticker", "accession").distinct().withColumn("_kept", F.lit(True))
    stored = pins.join(chunks.select("ticker").distinct(), "ticker", "left_semi")
    return stored.join(kept, ["ticker", "accession"], "left").withColumn("analysed", F.coalesce("_kept", F.lit(False))).drop("_kept")
