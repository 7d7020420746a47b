"""Queries of the evaluation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import evaluation
from lodestrata.plans.registry import register, table

_COMPARED_SQL = """
l AS (SELECT doc_id AS company, lang AS category, CAST(n_chars % 10 + 1 AS INTEGER) AS label FROM documents),
m AS (SELECT l.*, s.doc_id IS NOT NULL AS ran, CASE WHEN s.toxic = 0 THEN CAST(s.quality * 5 + 2 AS INTEGER) END AS model FROM l LEFT JOIN labels s ON s.doc_id = l.company),
c AS (
  SELECT company, category, label, model, CASE WHEN NOT ran THEN 'not run' WHEN model IS NULL THEN 'n/a' ELSE 'scored' END AS status,
    model - label AS gap, coalesce(abs(model - label) <= 1, false) AS within_1 FROM m)
"""


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as labels, by language; the table `labels` as a model's scores, null where toxic."""
    docs = table(spark, sf_dir, "documents")
    labels = docs.select(F.col("doc_id").alias("company"), F.col("lang").alias("category"), (F.col("n_chars") % 10 + 1).cast("int").alias("label"))
    scores = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("company"), F.when(F.col("toxic") == 0, (F.col("quality") * 5 + 2).cast("int")).alias("score"))
    return evaluation.compare_with_labels(scores, labels, ["company"]).join(labels.select("company", "category"), "company")


@register("label_comparison", f"WITH {_COMPARED_SQL} SELECT company, category, label, model, status, gap, within_1 FROM c")
def label_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir)


@register(
    "label_agreement",
    f"WITH {_COMPARED_SQL} SELECT category, count(*) AS labels, count(gap) AS scored, count(*) FILTER (within_1) AS within_1, CAST(sum(abs(gap)) AS BIGINT) AS total_gap, max(abs(gap)) AS largest_gap FROM c GROUP BY category",
)
def label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.agreement(_compared(spark, sf_dir), ["category"])


@register(
    "risk_overview",
    """
WITH s AS (SELECT o_custkey AS company, CAST(o_orderkey AS VARCHAR) AS category, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 10 + 1 END AS score FROM orders)
SELECT company, count(*) AS ran, CASE WHEN count(*) = 6 AND count(score) >= 4 THEN CAST(round_even(sum(score) / (10.0::DOUBLE * count(score)) * 100, 0) AS INTEGER) END AS overall,
  count(*) = 6 AS complete, coalesce(string_agg(category, ',' ORDER BY category) FILTER (score IS NULL), '') AS n_a FROM s GROUP BY company
""",
)
def risk_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company"), F.col("o_orderkey").cast("string").alias("category"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 10 + 1).alias("score"))
    return evaluation.risk_overview(scores).withColumn("n_a", F.array_join("n_a", ","))


_FLAT = r"regexp_replace({}, '[\s\x0B\x{{85}}\p{{Z}}]+', ' ', 'g')"


@register(
    "benchmark_hits",
    f"SELECT d.doc_id, b.item_id FROM (SELECT doc_id, {_FLAT.format('text')} AS t FROM documents) d JOIN (SELECT item_id, trim({_FLAT.format('text')}) AS p FROM benchmark) b ON b.p <> '' AND contains(d.t, b.p)",
)
def benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold which passages."""
    passages = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    return evaluation.containing(table(spark, sf_dir, "documents"), passages)


@register(
    "retrieval_checks",
    f"""
WITH r AS (SELECT concat('check ', conv_id % 5) AS check_name, role AS section, conv_id * 1000 + turn AS chunk_index, {_FLAT.format('text')} AS t FROM conversations),
p AS (SELECT concat('check ', unnest(range(0, 5))) AS check_name),
h AS (SELECT p.check_name, count(*) FILTER (contains(t, 'the')) AS n_hit, count(r.t) AS n_retrieved, min(CASE WHEN contains(t, 'the') THEN chunk_index END) AS first_hit FROM p LEFT JOIN r USING (check_name) GROUP BY p.check_name)
SELECT check_name, n_hit, n_retrieved, first_hit FROM h
""",
)
def retrieval_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    at = (F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_index")
    retrieved = rows.select(F.concat(F.lit("check "), (F.col("conv_id") % 5).cast("string")).alias("check_name"), F.col("role").alias("section"), at, at.alias("n"), "text")
    passages = spark.range(5).select(F.concat(F.lit("check "), F.col("id").cast("string")).alias("check_name"), F.lit("the").alias("passage"))
    checks = evaluation.check_retrieval(retrieved, passages)
    return checks.select("check_name", F.size("hit").cast("long").alias("n_hit"), F.size("retrieved").cast("long").alias("n_retrieved"), F.array_min(F.transform("hit", lambda h: h["chunk_index"])).alias("first_hit"))
