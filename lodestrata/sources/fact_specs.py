"""Fact specifications in TOML: facts, ratios and notes by ticker."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

FACT = "ticker string, ord int, id string, topic string, label string, section string, statement string, quote string, value string, unit string"
RATIO = "ticker string, ord int, topic string, label string, numerator array<string>, denominator array<string>"
NOTE = "ticker string, ord int, note string"


def fact_tables(spark: SparkSession, specs: dict[str, dict]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """facts, ratios, notes of parsed specifications (ticker -> {facts, ratios, notes}); ord keeps their order."""

    def rows(part: str, schema: str) -> DataFrame:
        names = [f.split()[0] for f in schema.split(", ")][2:]
        data = [(t, i, *((x.get(n) for n in names) if isinstance(x, dict) else (x,))) for t, spec in specs.items() for i, x in enumerate(spec.get(part, []))]
        return spark.createDataFrame(data, schema)

    return rows("facts", FACT), rows("ratios", RATIO), rows("notes", NOTE)


def read_facts(spark: SparkSession, path: str | Path) -> tuple[DataFrame, DataFrame, DataFrame]:
    return fact_tables(spark, tomllib.loads(Path(path).read_text(encoding="utf-8")))
