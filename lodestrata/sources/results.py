"""Kept results of risk analyses: JSON by ticker and accession."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

_PASSAGE = "struct<n: int, label: string, text: string, company: string, form: string, fiscal_year: string, section: string, section_title: string, resolved_from: string, accession: string, source_url: string, cited: boolean>"
_CHECK = "struct<cited: array<long>, invalid_citations: array<long>, unverified_figures: array<string>, approximate_ratios: array<string>>"
RESULTS = (
    "struct<overall: int, summary: string, scores: map<string, struct<score: int, reason: string>>, read_from: map<string, string>,"
    f" evidence: map<string, struct<passages: array<{_PASSAGE}>, check: {_CHECK}>>>"
)
RECORD = f"ticker string, accession string, created string, source string, results {RESULTS}"


def save_results(records: DataFrame, path: str, source: str, created: str | None = None) -> None:
    """Put records (ticker, accession, results) in the place of those kept for the same filings; others stay."""
    made = created or datetime.now().strftime("%Y-%m-%d %H:%M")
    rows = records.select("ticker", "accession", F.lit(made).alias("created"), F.lit(source).alias("source"), "results")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false").partitionBy("ticker", "accession").json(path)


def load_results(spark: SparkSession, path: str) -> DataFrame:
    """All kept records; an empty table if there is none."""
    try:
        return spark.read.schema(RECORD).json(path)
    except AnalysisException:
        return spark.createDataFrame([], RECORD)


def with_results(pins: DataFrame, kept: DataFrame) -> DataFrame:
    """The pins with created, source and results; null where nothing is kept."""
    return pins.join(kept, ["ticker", "accession"], "left")
