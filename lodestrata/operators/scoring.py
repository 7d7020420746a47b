"""Risk scores: from chunks to scores, checks, an overall score and a summary.

All tickers and categories are one plan; what is the same for all categories of a ticker (scale passage,
balance sheet, source of Item 7A) is one row of it, joined in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.constants import BALANCE_SHEET_CATEGORIES, CATEGORY_QUERIES, EXTRA_SEARCHES, MIN_SCORED_CATEGORIES, NO_TEXT_REASON, SCORE_MAX_TOKENS, SUMMARY_K, SUMMARY_MAX_TOKENS, SUMMARY_QUERY
from lodestrata.functions.figures import check_answer
from lodestrata.functions.labels import numbered_context
from lodestrata.functions.replies import parse_reply
from lodestrata.functions.rubric import overall_score, risk_level
from lodestrata.operators.answers import gathered, marked_passages
from lodestrata.operators.completion import Client, complete, complete_kept
from lodestrata.operators.embedding import Embedder, HashingEmbedder
from lodestrata.operators.prompts import score_prompt, summary_prompt
from lodestrata.operators.retrieval import CHUNK_KEY, balance_sheet_passages, category_chunks, item_7a_sources, read_from, scale_passages, search, section_quotas
from lodestrata.session import cut_lineage


def query_vectors(spark: SparkSession, make: Callable[[], Embedder] = HashingEmbedder) -> DataFrame:
    """query, vector of the categories' searches and of the summary's: a fixed set."""
    queries = [*CATEGORY_QUERIES.values(), *(q for q, _ in EXTRA_SEARCHES.values()), SUMMARY_QUERY]
    vectors = make().embed(queries)
    return spark.createDataFrame([(q, [float(x) for x in v]) for q, v in zip(queries, vectors, strict=True)], "query string, vector array<float>")


def category_prompts(chunks: DataFrame, pins: DataFrame, vectors: DataFrame) -> DataFrame:
    """ticker, cat_ord, category, read_from, passages, prompt; no passages and no prompt where nothing was found."""
    quotas = section_quotas(item_7a_sources(chunks, pins))
    found = category_chunks(chunks, quotas, vectors)
    by = ["ticker", "category"]
    names = [c for c in found.columns if c not in ("chunk_id",)]
    # The scale passage comes first, then the balance sheet's (of the categories that read it).
    scale = scale_passages(chunks, pins).withColumn("n", F.lit(-2))
    balance = balance_sheet_passages(chunks).withColumn("n", F.lit(-1))
    kept = found.select(*by).distinct()
    fixed = kept.join(scale, "ticker").unionByName(kept.filter(F.col("category").isin(*BALANCE_SHEET_CATEGORIES)).join(balance, "ticker"))
    united = found.select(*names).unionByName(fixed.select(*names))
    listed = gathered(united, by).withColumn("_sheet", F.exists("passages", lambda p: p["n"] == -1))
    numbered = listed.withColumn("passages", F.transform("passages", lambda p, i: p.withField("n", (i + 1).cast("int"))))
    prompted = numbered.withColumn("prompt", score_prompt(F.col("category"), numbered_context(F.col("passages")), F.col("_sheet"))).drop("_sheet")
    each = pins.select("ticker", F.posexplode(F.array(*map(F.lit, CATEGORY_QUERIES))).alias("cat_ord", "category"))
    return each.join(prompted, by, "left").join(read_from(found, by), by, "left")


def score_categories(chunks: DataFrame, pins: DataFrame, vectors: DataFrame, client: Callable[[], Client], replies: str | None = None) -> DataFrame:
    """ticker, cat_ord, category, score, reason, read_from, passages, check, stopped. Categories without text
    are not sent to the model; replies are written before anything is worked out from them. With a path for replies they are kept
    there by step, and what has been answered for the same prompt is not asked again."""
    asked = category_prompts(chunks, pins, vectors)
    if replies is None:
        replied = cut_lineage(complete(asked, client, SCORE_MAX_TOKENS))
    else:
        asked = cut_lineage(asked.withColumn("_asked", F.sha2(F.concat_ws("\x1f", "ticker", "category", "prompt"), 256)))
        replied = cut_lineage(complete_kept(asked, "_asked", replies, client, SCORE_MAX_TOKENS)).drop("_asked")
    parsed = replied.withColumn("_r", parse_reply(F.col("reply")))
    there = F.col("prompt").isNotNull() & F.col("stopped").isNull()
    reason = F.when(F.col("prompt").isNull(), NO_TEXT_REASON).when(there, F.col("_r.reason"))
    out = parsed.select("ticker", "cat_ord", "category", F.when(there, F.col("_r.score")).alias("score"), reason.alias("reason"), F.coalesce("read_from", F.lit("")).alias("read_from"), "passages", "stopped", there.alias("_there"))
    marked = out.withColumn("passages", F.when(F.col("_there"), marked_passages(F.col("passages"), F.col("reason"))))
    return marked.withColumn("check", F.when(F.col("_there"), check_answer(F.col("reason"), F.col("passages"), True))).drop("_there")


def overall_scores(scores: DataFrame, by: str = "ticker") -> DataFrame:
    """by, overall, level, scored, categories."""
    agg = scores.groupBy(by).agg(overall_score(F.col("score")).alias("overall"), F.count("score").alias("scored"), F.count("*").alias("categories"))
    return agg.select(by, "overall", risk_level(F.col("overall") / 10).alias("level"), "scored", "categories")


def score_list(rows: Column) -> Column:
    """array<struct<cat_ord, category, score>> as lines "- category: 7/10 (HIGH)"."""
    line = lambda r: F.concat(F.lit("- "), r["category"], F.lit(": "), F.coalesce(F.concat(r["score"].cast("string"), F.lit("/10 ("), F.upper(risk_level(r["score"])), F.lit(")")), F.lit("n/a (could not be scored)")))
    return F.array_join(F.transform(rows, line), "\n")


def summaries(chunks: DataFrame, scores: DataFrame, vectors: DataFrame, client: Callable[[], Client]) -> DataFrame:
    """ticker, overall, level, scored, categories, summary, stopped. Without an overall score no call is made."""
    overall = overall_scores(scores)
    rows = scores.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("cat_ord", "category", "score"))).alias("_rows"))
    searches = scores.select("ticker", F.lit(SUMMARY_QUERY).alias("query")).distinct().join(vectors, "query").select(
        F.col("ticker").alias("search_id"), F.lit(0).alias("ord"), "ticker", F.lit("7").alias("section"), F.lit(SUMMARY_K).alias("k"), "vector"
    )
    context = search(chunks, searches, list(CHUNK_KEY), SUMMARY_K).groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("_c"))
    joined = overall.join(rows, "ticker").join(context, "ticker", "left")
    text = F.coalesce(F.array_join(F.transform("_c", lambda c: c["text"]), "\n\n"), F.lit(""))
    prompt = F.when(F.col("overall").isNotNull(), summary_prompt(score_list(F.col("_rows")), F.col("overall"), text))
    replied = complete(joined.withColumn("prompt", prompt), client, SUMMARY_MAX_TOKENS)
    missing = F.concat(F.lit(f"Fewer than {MIN_SCORED_CATEGORIES} of "), F.col("categories").cast("string"), F.lit(" risk categories could be scored, so no summary was generated."))
    return replied.select("ticker", "overall", "level", "scored", "categories", F.when(F.col("overall").isNull(), missing).otherwise(F.trim("reply")).alias("summary"), "stopped")


def run_risk_analysis(chunks: DataFrame, pins: DataFrame, client: Callable[[], Client], make: Callable[[], Embedder] = HashingEmbedder) -> tuple[DataFrame, DataFrame]:
    """Scores by ticker and category, and a row with overall score and summary by ticker."""
    vectors = query_vectors(chunks.sparkSession, make)
    scores = cut_lineage(score_categories(chunks, pins, vectors, client))
    return scores, summaries(chunks, scores, vectors, client)


def result_records(pins: DataFrame, scores: DataFrame, totals: DataFrame) -> DataFrame:
    """ticker, accession, results: one nested record a filing, as the result cache keeps it."""
    each = F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", F.struct("score", "reason").alias("v")))))
    read = F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", F.col("read_from").alias("v")))))
    evidence = F.map_from_entries(F.collect_list(F.struct("category", F.struct("passages", "check").alias("v"))))
    by = scores.groupBy("ticker").agg(each.alias("scores"), read.alias("read_from"), evidence.alias("evidence"))
    joined = pins.select("ticker", "accession").join(totals.select("ticker", "overall", "summary"), "ticker").join(by, "ticker")
    return joined.select("ticker", "accession", F.struct("overall", "summary", "scores", "read_from", "evidence").alias("results"))
