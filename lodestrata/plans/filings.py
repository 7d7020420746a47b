"""Queries of the pins and the archive's indexes. Orders stand for filings, customers for companies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.labels import filing_label
from lodestrata.plans.registry import register, table
from lodestrata.sources import archive, pins

_FORM = "CASE o_orderstatus WHEN 'F' THEN '10-K' WHEN 'O' THEN '10-Q' ELSE '10-K/A' END"
_DATE = "date_format(o_orderdate, 'yyyy-MM-dd')"
_DATE_SQL = "strftime(o_orderdate, '%Y-%m-%d')"


@register(
    "recent_filings",
    f"""
WITH k AS (SELECT o_custkey AS cik, o_orderkey, {_DATE_SQL} AS d FROM orders WHERE o_orderstatus = 'F'),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY cik ORDER BY o_orderkey) - 1 AS INTEGER) AS pos FROM k)
SELECT cik, pos, concat('A-', o_orderkey) AS accession, d AS filing_date, d AS period_end, concat('d', o_orderkey, '.htm') AS primary_document FROM r WHERE pos < 5
""",
)
def recent_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.struct("o_orderkey", F.expr(_FORM).alias("form"), F.expr(_DATE).alias("d")).alias("r"))
    by = rows.groupBy(F.col("o_custkey").alias("cik")).agg(F.sort_array(F.collect_list("r")).alias("rs"))
    each = lambda f: F.transform("rs", f)
    key = lambda r: r["o_orderkey"].cast("string")
    recent = F.struct(
        each(lambda r: r["form"]).alias("form"), each(lambda r: F.concat(F.lit("A-"), key(r))).alias("accessionNumber"), each(lambda r: r["d"]).alias("filingDate"),
        each(lambda r: r["d"]).alias("reportDate"), each(lambda r: F.concat(F.lit("d"), key(r), F.lit(".htm"))).alias("primaryDocument"),
    )
    index = by.select("cik", F.to_json(F.struct(F.struct(recent.alias("recent")).alias("filings"))).alias("json"))
    return archive.recent_annual_reports(index)


@register("ticker_lookup", "SELECT CAST(n_nationkey AS BIGINT) AS cik, concat('Nation ', n_nationkey) AS title FROM nation WHERE upper(n_name) = upper('Nation_7')")
def ticker_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.struct(F.col("n_nationkey").cast("long").alias("cik_str"), F.lower("n_name").alias("ticker"), F.concat(F.lit("Nation "), F.col("n_nationkey").cast("string")).alias("title"))
    rows = table(spark, sf_dir, "nation").agg(F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string").alias("k"), entry.alias("v")))).alias("m"))
    return archive.lookup_ticker(rows.select(F.to_json("m").alias("json")), F.lit("Nation_7"))


@register(
    "pin_mismatches",
    f"""
SELECT concat('T', o_orderkey) AS ticker, concat('A-', o_orderkey) AS accession, CASE WHEN o_orderkey % 7 = 0 THEN 'accession not among recent 10-K filings' ELSE concat_ws('; ',
  CASE WHEN o_orderkey % 11 = 0 THEN 'period_end is 1900-01-01' END, CASE WHEN o_orderkey % 13 = 0 THEN 'primary_document is other.htm' END) END AS problems,
  NOT (o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0) AS ok FROM orders
""",
)
def pin_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    rows = table(spark, sf_dir, "orders")
    pinned = rows.select(text("T", k).alias("ticker"), F.col("o_custkey").alias("cik"), text("A-", k).alias("accession"), F.expr(_DATE).alias("period_end"), text("d", k, ".htm").alias("primary_document"))
    recent = rows.select(
        F.col("o_custkey").alias("cik"), F.when(k % 7 == 0, text("B-", k)).otherwise(text("A-", k)).alias("accession"),
        F.when(k % 11 == 0, "1900-01-01").otherwise(F.expr(_DATE)).alias("period_end"), F.when(k % 13 == 0, "other.htm").otherwise(text("d", k, ".htm")).alias("primary_document"),
    )
    return archive.verify_pins(pinned, recent)


@register("not_fetched", "SELECT concat('T', o_custkey) AS ticker, concat('0-', o_orderkey) AS accession FROM orders WHERE o_orderstatus <> 'F'")
def not_fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey").cast("string")
    path = pins.cache_path(F.concat(F.lit("T"), F.col("o_custkey").cast("string")), F.concat(F.lit("0-"), k), F.lit("d.htm"))
    pinned = rows.select(F.concat(F.lit("T"), F.col("o_custkey").cast("string")).alias("ticker"), F.concat(F.lit("0-"), k).alias("accession"), path.alias("cache_path"))
    files = rows.filter("o_orderstatus = 'F'").select(path.alias("path"))
    return archive.not_fetched(pinned, files).select("ticker", "accession")


@register("filing_urls", "SELECT o_orderkey, concat('https://www.sec.gov/Archives/edgar/data/', o_custkey, '/0', o_orderkey, '25/d', o_orderkey, '.htm') AS url, concat('T', o_custkey, '/0-', o_orderkey, '-25/d', o_orderkey, '.htm') AS path FROM orders")
def filing_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    accession, document = F.concat(F.lit("0-"), k, F.lit("-25")), F.concat(F.lit("d"), k, F.lit(".htm"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", pins.filing_url(F.col("o_custkey"), accession, document).alias("url"), pins.cache_path(F.concat(F.lit("T"), F.col("o_custkey").cast("string")), accession, document).alias("path")
    )


@register("filing_labels", "SELECT c_custkey, concat(c_name, ' (', c_mktsegment, ') · 10-K FY', 2000 + c_nationkey) AS label FROM customer")
def filing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", filing_label(F.col("c_name"), F.col("c_mktsegment"), F.lit("10-K"), F.lit(2000) + F.col("c_nationkey")).alias("label"))
