"""Whole runs: questions and scores of an evaluation, scoring that keeps what it got, analyses that replace kept ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.limits import rate_limit_message
from lodestrata.operators.answers import ask
from lodestrata.operators.completion import Client
from lodestrata.operators.embedding import Embedder, HashingEmbedder
from lodestrata.operators.evaluation import QUESTIONS, TESLA_FIGURES, TESLA_QUESTION, stated_figures
from lodestrata.operators.scoring import query_vectors, result_records, score_categories, summaries
from lodestrata.session import cut_lineage
from lodestrata.sources.results import save_results


def evaluation_questions(pins: DataFrame, make: Callable[[], Embedder] = HashingEmbedder) -> DataFrame:
    """question_id ("TICKER name"), ticker, question, vector: what is asked of every filing, and one question more of TSLA."""
    model = make()
    asked = [(name, text, None) for name, text in QUESTIONS.items()] + [("figures", TESLA_QUESTION, "TSLA")]
    rows = [F.struct(F.lit(n).alias("name"), F.lit(q).alias("question"), F.lit(t).cast("string").alias("only"), F.array(*[F.lit(float(x)).cast("float") for x in model.embed([q])[0]]).alias("vector")) for n, q, t in asked]
    each = pins.select("ticker", F.inline(F.array(*rows))).filter(F.col("only").isNull() | (F.col("only") == F.col("ticker")))
    return each.select(F.concat_ws(" ", "ticker", "name").alias("question_id"), "ticker", "question", "vector")


def run_llm_metrics(chunks: DataFrame, pins: DataFrame, client: Callable[[], Client], make: Callable[[], Embedder] = HashingEmbedder) -> tuple[DataFrame, DataFrame, DataFrame]:
    """answers (question_id, answer, passages, check, stated), scores (as of score_categories) and not_scored (ticker, categories):
    the questions and the categories of every filing, each asked once and written before anything is worked out from it."""
    answers = cut_lineage(stated_figures(ask(chunks, evaluation_questions(pins, make), client), TESLA_FIGURES))
    scores = cut_lineage(score_categories(chunks, pins, query_vectors(chunks.sparkSession, make), client))
    missing = F.array_sort(F.collect_list(F.when(F.col("score").isNull(), F.col("category"))))
    return answers, scores, scores.groupBy("ticker").agg(missing.alias("categories"))


def score_risk(chunks: DataFrame, pins: DataFrame, client: Callable[[], Client], make: Callable[[], Embedder] = HashingEmbedder, replies: str | None = None) -> tuple[DataFrame, str | None]:
    """The scores that there are, and why the others are missing (None if none is): a quota that is used up ends the
    calls, and what was answered before stays; with a path for replies, for the next run too."""
    scores = cut_lineage(score_categories(chunks, pins, query_vectors(chunks.sparkSession, make), client, replies))
    reason = scores.agg(F.max("stopped")).first()[0]
    return scores.filter("stopped IS NULL").drop("stopped"), reason


def run_and_cache(chunks: DataFrame, pins: DataFrame, client: Callable[[], Client], path: str, source: str, make: Callable[[], Embedder] = HashingEmbedder, created: str | None = None) -> DataFrame:
    """ticker, saved, message: analyse the pinned filings and put the results in the place of those kept at path. A filing for
    which a call was refused keeps the result that it had; message says what the service told."""
    vectors = query_vectors(chunks.sparkSession, make)
    scores = cut_lineage(score_categories(chunks, pins, vectors, client))
    state = cut_lineage(scores.groupBy("ticker").agg(F.max("stopped").alias("stopped")))
    whole = scores.join(state.filter("stopped IS NULL").select("ticker"), "ticker", "left_semi")
    totals = cut_lineage(summaries(chunks, whole, vectors, client))
    refused = totals.filter("stopped IS NOT NULL").select("ticker", F.col("stopped").alias("refused"))
    done = totals.join(refused, "ticker", "left_anti")
    save_results(result_records(pins, whole.join(done.select("ticker"), "ticker", "left_semi"), done), path, source, created)
    told = state.join(refused, "ticker", "left").withColumn("why", F.coalesce("stopped", "refused"))
    return told.select("ticker", F.col("why").isNull().alias("saved"), F.when(F.col("why").isNotNull(), rate_limit_message(F.col("why"))).alias("message"))
