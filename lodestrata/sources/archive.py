"""The public filing archive: its JSON indexes, its documents, and checks of pins against them."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.constants import ANNUAL_FORM, REQUEST_ATTEMPTS, REQUEST_SPACING_SECONDS, REQUEST_TIMEOUT_SECONDS, SUBMISSIONS_URL, TICKERS_URL

SUBMISSIONS = "struct<filings: struct<recent: struct<form: array<string>, accessionNumber: array<string>, filingDate: array<string>, reportDate: array<string>, primaryDocument: array<string>>>>"
TICKERS = "map<string, struct<cik_str: long, ticker: string, title: string>>"


class ArchiveClient:
    """Gets documents one by one, spaced out; 429 and 503 are tried again after 2, 4, ... seconds."""

    def __init__(self, user_agent: str, opener: Callable | None = None, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        if "@" not in user_agent:
            raise ValueError("the archive asks for a contact address in the user agent")
        self.user_agent, self.open, self.sleep, self.clock, self.last = user_agent, opener or urllib.request.urlopen, sleep, clock, float("-inf")

    def get(self, url: str) -> bytes:
        for attempt in range(1, REQUEST_ATTEMPTS + 1):
            if (wait := self.last + REQUEST_SPACING_SECONDS - self.clock()) > 0:
                self.sleep(wait)
            self.last = self.clock()
            try:
                with self.open(urllib.request.Request(url, headers={"User-Agent": self.user_agent}), timeout=REQUEST_TIMEOUT_SECONDS) as answer:
                    return answer.read()
            except urllib.error.HTTPError as error:
                if error.code not in (429, 503) or attempt == REQUEST_ATTEMPTS:
                    raise
                self.sleep(2**attempt)
        raise AssertionError("unreachable")


def recent_annual_reports(submissions: DataFrame, limit: int = 5, key: str = "cik", json: str = "json") -> DataFrame:
    """key, pos, accession, filing_date, period_end, primary_document: the first `limit` annual reports of each
    submissions index (key, json), whose parallel arrays are zipped within the row."""
    recent = F.from_json(F.col(json), F.lit(SUBMISSIONS))["filings"]["recent"]
    rows = F.arrays_zip(recent["form"].alias("form"), recent["accessionNumber"].alias("accession"), recent["filingDate"].alias("filing_date"), recent["reportDate"].alias("period_end"), recent["primaryDocument"].alias("primary_document"))
    first = F.slice(F.filter(rows, lambda r: r["form"] == ANNUAL_FORM), 1, limit)
    return submissions.select(key, F.posexplode(first).alias("pos", "r")).select(key, "pos", "r.accession", "r.filing_date", "r.period_end", "r.primary_document")


def lookup_ticker(tickers: DataFrame, ticker: Column, json: str = "json") -> DataFrame:
    """cik, title of the index's entries (one row, json) of this ticker in any case."""
    entries = tickers.select(F.explode(F.map_values(F.from_json(F.col(json), F.lit(TICKERS)))).alias("e"))
    return entries.filter(F.upper("e.ticker") == F.upper(ticker)).select(F.col("e.cik_str").alias("cik"), F.col("e.title").alias("title"))


def lookup_cik(spark: SparkSession, client: ArchiveClient, ticker: str) -> tuple[int, str]:
    table = spark.createDataFrame([(client.get(TICKERS_URL).decode(),)], "json string")
    found = lookup_ticker(table, F.lit(ticker)).first()
    if found is None:
        raise LookupError(f"ticker {ticker} is not in the archive's list")
    return found["cik"], found["title"]


def submissions(spark: SparkSession, client: ArchiveClient, ciks: list[int]) -> DataFrame:
    return spark.createDataFrame([(int(c), client.get(SUBMISSIONS_URL.format(cik=int(c))).decode()) for c in ciks], "cik long, json string")


def verify_pins(pins: DataFrame, recent: DataFrame) -> DataFrame:
    """ticker, accession, problems (empty: none), ok: pins against the archive's annual reports of their company."""
    known = recent.select("cik", "accession", F.col("period_end").alias("_period"), F.col("primary_document").alias("_document"), F.lit(True).alias("_known"))
    met = pins.join(known, ["cik", "accession"], "left")
    problems = F.when(F.col("_known").isNull(), "accession not among recent 10-K filings").otherwise(
        F.concat_ws(
            "; ",
            F.when(~F.col("_period").eqNullSafe(F.col("period_end")), F.concat(F.lit("period_end is "), F.coalesce("_period", F.lit("")))),
            F.when(~F.col("_document").eqNullSafe(F.col("primary_document")), F.concat(F.lit("primary_document is "), F.coalesce("_document", F.lit("")))),
        )
    )
    return met.select("ticker", "accession", problems.alias("problems")).withColumn("ok", F.col("problems") == "")


def not_fetched(pins: DataFrame, files: DataFrame) -> DataFrame:
    """The pins whose cache_path is not among files (path)."""
    return pins.join(files.select(F.col("path").alias("cache_path")), "cache_path", "left_anti")


def fetch(pins: list[dict], urls: dict[str, str], client: ArchiveClient, root: Path) -> list[str]:
    """Download what is not there yet; the tickers that were. The archive's limits allow one request at a time."""
    fetched = []
    for pin in pins:
        path = root / pin["ticker"] / pin["accession"] / pin["primary_document"]
        if not path.exists():
            content = client.get(urls[pin["accession"]])
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(content)
            fetched.append(pin["ticker"])
    return fetched


def read_filings(spark: SparkSession, root: str) -> DataFrame:
    """accession, html of the cached documents <root>/<ticker>/<accession>/<document>, in any store Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(F.element_at(F.split("path", "/"), -2).alias("accession"), F.col("content").alias("html"))


def write_packed(filings: DataFrame, root: str) -> None:
    """Filings (ticker, accession, html) packed as Parquet, as many files as tasks: a file a document costs more than its reading
    where documents are many."""
    filings.select("ticker", "accession", F.col("html").cast("binary").alias("html")).write.parquet(root)


def read_packed(spark: SparkSession, root: str) -> DataFrame:
    """accession, html of packed filings."""
    return spark.read.parquet(root).select("accession", "html")
