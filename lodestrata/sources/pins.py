"""Pinned filings: a small registry in TOML, and the addresses that follow from it."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.constants import ANNUAL_FORM, ARCHIVE_URL, SCALE_FIELDS

PIN = (
    "ticker string, company string, cik long, form string, fiscal_year int, period_end string, accession string, primary_document string,"
    " revenue_line string, operating_income_line string, net_income_line string"
)
_FIELDS = [f.split()[0] for f in PIN.split(", ")]


class PinError(ValueError):
    """The registry is missing or not fit for use."""


def read_pins(path: str | Path) -> list[dict]:
    """The pins of a registry. Other forms than the annual report (amendments too) and pins without the names
    of their three scale rows are refused."""
    if not Path(path).exists():
        raise PinError(f"{Path(path).name} not found; pin filings first")
    pins = tomllib.loads(Path(path).read_text(encoding="utf-8"))["filing"]
    for pin in pins:
        if pin["form"] != ANNUAL_FORM:
            raise PinError(f"{pin['ticker']}: form {pin['form']!r} is not allowed; only {ANNUAL_FORM!r}")
        if missing := [f for f in SCALE_FIELDS.values() if not pin.get(f)]:
            raise PinError(f"{pin['ticker']}: {', '.join(missing)} not pinned")
    return pins


def filing_url(cik: Column, accession: Column, document: Column) -> Column:
    return F.concat(F.lit(ARCHIVE_URL), cik.cast("long").cast("string"), F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")), F.lit("/"), document)


def cache_path(ticker: Column, accession: Column, document: Column) -> Column:
    return F.concat_ws("/", ticker, accession, document)


def pins_table(spark: SparkSession, pins: list[dict]) -> DataFrame:
    """The pins with source_url and cache_path."""
    table = spark.createDataFrame([tuple(p.get(f) for f in _FIELDS) for p in pins], PIN)
    url = filing_url(F.col("cik"), F.col("accession"), F.col("primary_document"))
    return table.withColumns({"source_url": url, "cache_path": cache_path(F.col("ticker"), F.col("accession"), F.col("primary_document"))})


def load_pins(spark: SparkSession, path: str | Path) -> DataFrame:
    return pins_table(spark, read_pins(path))
