"""Scores against labels, and whether retrieval finds the passages that it must."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.constants import CATEGORY_QUERIES
from lodestrata.functions.rubric import overall_score
from lodestrata.functions.text import collapse, stripped
from lodestrata.operators.passages import holding

# Questions that are asked of every filing, and the passages that must be retrieved for them.
QUESTIONS = {"revenue": "What was the total revenue?", "net_income": "How did net income change year over year?"}
TESLA_QUESTION = "What were Tesla's total revenues in fiscal 2025 and fiscal 2024?"
TESLA_FIGURES = ("94,827", "97,690")
EXPECTED_PASSAGES = [
    ("tesla_revenue", "Total revenues 94,827 97,690"),
    ("tesla_revenue", "Total revenues | 2025: 94,827 | 2024: 97,690"),
    ("pm_fx", "Foreign currency rates $97 $152 $197 $97"),
    ("pm_fx", "Foreign currency rates | At December 31, 2025: $97 | Average: $152 | High: $197 | Low: $97"),
    ("AAPL_revenue", "Total net sales | September 27, 2025: 416,161 | September 28, 2024: 391,035"),
    ("AAPL_net_income", "Net income | September 27, 2025: $112,010 | September 28, 2024: $93,736"),
    ("TSLA_revenue", "Total revenues | 2025: 94,827 | 2024: 97,690"),
    ("TSLA_net_income", "Net income attributable to common stockholders | 2025: $3,794 | 2024: $7,091"),
    ("KO_revenue", "Net Operating Revenues | 2025: $47,941 | 2024: $47,061"),
    ("KO_net_income", "Net Income Attributable to Shareowners of The Coca-Cola Company | 2025: $13,107 | 2024: $10,631"),
    ("PM_revenue", "Net revenues 1 & 2 (Notes 5 & 11) | 2025: $40,648 | 2024: $37,878"),
    ("PM_net_income", "Net earnings attributable to PMI | 2025: $11,348 | 2024: $7,057"),
]


def expected_passages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EXPECTED_PASSAGES, "check_name string, passage string")


def hits(retrieved: DataFrame, passages: DataFrame, key: list[str] | None = None) -> DataFrame:
    """check_name and key of each retrieved chunk (check_name, key, text) that holds one of its check's passages."""
    key = key or ["section", "chunk_index"]
    met = retrieved.join(passages, "check_name").filter(F.contains(collapse(F.col("text")), F.col("passage")))
    return met.select("check_name", *key).distinct()


def _ordered(key: list[str]) -> Column:
    return F.transform(F.sort_array(F.collect_list(F.struct("n", *key))), lambda r: F.struct(*[r[k].alias(k) for k in key]))


def check_retrieval(retrieved: DataFrame, passages: DataFrame) -> DataFrame:
    """check_name, hit, retrieved (arrays of section and chunk_index, in order of n) for every check with passages."""
    key = ["section", "chunk_index"]
    found = hits(retrieved, passages, key).withColumn("_hit", F.lit(True))
    marked = retrieved.join(found, ["check_name", *key], "left")
    got = marked.groupBy("check_name").agg(
        F.transform(F.filter(F.sort_array(F.collect_list(F.struct("n", *key, "_hit"))), lambda r: r["_hit"]), lambda r: F.struct(*[r[k].alias(k) for k in key])).alias("hit"),
        _ordered(key).alias("retrieved"),
    )
    return passages.select("check_name").distinct().join(got, "check_name", "left")


def containing(docs: DataFrame, passages: DataFrame, key: str = "doc_id", text: str = "text", passage_key: str = "item_id", passage: str = "passage") -> DataFrame:
    """key, passage_key: the texts that hold a passage, white space collapsed on both sides. See passages.holding()."""
    bodies = docs.select(F.col(key), collapse(F.col(text)).alias("_t"))
    return holding(bodies, passages.select(F.col(passage_key), stripped(collapse(F.col(passage))).alias("_p")), key, passage_key)


def compare_with_labels(scores: DataFrame, labels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A row for each label (by, label): model, status ("not run": no row in scores; "n/a": a null score;
    "scored"), gap (model - label) and within_1."""
    by = by or ["company", "category"]
    ran = scores.select(*by, F.col("score").alias("model"), F.lit(True).alias("_ran"))
    joined = labels.join(ran, by, "left")
    gap = F.col("model") - F.col("label")
    status = F.when(F.col("_ran").isNull(), "not run").when(F.col("model").isNull(), "n/a").otherwise("scored")
    return joined.select(*by, "label", "model", status.alias("status"), gap.alias("gap"), F.coalesce(F.abs(gap) <= 1, F.lit(False)).alias("within_1"))


def agreement(compared: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by (none: one row), labels, scored, within_1, total_gap, largest_gap."""
    gap = F.abs("gap")
    counts = [F.count("*").alias("labels"), F.count("gap").alias("scored"), F.count_if("within_1").alias("within_1"), F.sum(gap).alias("total_gap"), F.max(gap).alias("largest_gap")]
    return compared.groupBy(*(by or [])).agg(*counts)


def risk_overview(scores: DataFrame, by: str = "company", categories: int = len(CATEGORY_QUERIES)) -> DataFrame:
    """by, ran, overall (null unless all categories ran), complete, n_a (the categories without a score)."""
    agg = scores.groupBy(by).agg(
        F.count("*").alias("ran"), overall_score(F.col("score")).alias("_overall"),
        F.array_sort(F.collect_list(F.when(F.col("score").isNull(), F.col("category")))).alias("n_a"),
    )
    complete = F.col("ran") == categories
    return agg.select(by, "ran", F.when(complete, F.col("_overall")).alias("overall"), complete.alias("complete"), "n_a")


def stated_figures(answers: DataFrame, figures: tuple[str, ...] = TESLA_FIGURES, answer: str = "answer") -> DataFrame:
    """answers with `stated`: a map from figure to whether the answer has it."""
    return answers.withColumn("stated", F.create_map(*[x for f in figures for x in (F.lit(f), F.contains(F.col(answer), F.lit(f)))]))
