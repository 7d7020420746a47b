"""Risk labels in CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.constants import LABEL_CATEGORIES

LABEL = "company string, category string, my_score string, my_reason string"


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """company, category, label, reason of the rows that have a score."""
    rows = spark.read.schema(LABEL).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    return rows.filter(F.trim("my_score") != "").select("company", "category", F.trim("my_score").cast("int").alias("label"), F.coalesce("my_reason", F.lit("")).alias("reason"))


def label_template(tickers: DataFrame) -> DataFrame:
    """A row without score and reason for each ticker and category."""
    each = F.posexplode(F.array(*map(F.lit, LABEL_CATEGORIES))).alias("cat_ord", "category")
    return tickers.select(F.col("ticker").alias("company"), each).select("*", F.lit("").alias("my_score"), F.lit("").alias("my_reason"))


def write_label_template(tickers: DataFrame, path: str) -> None:
    """Write the template unless there is something at path."""
    rows = label_template(tickers).orderBy("company", "cat_ord").drop("cat_ord")
    rows.coalesce(1).write.mode("ignore").option("header", True).option("emptyValue", "").csv(path)
