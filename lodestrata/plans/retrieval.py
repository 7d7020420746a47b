"""Queries of the search operators. In `embeddings`, the label stands for a document's Item; vector 0 asks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import retrieval
from lodestrata.plans.registry import register, table
from lodestrata.sources import store

_SCORED = """
q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0),
s AS (
  SELECT e.vec_id, e.label, list_dot_product(e.embedding::DOUBLE[], q.v::DOUBLE[]) AS sim
  FROM embeddings e CROSS JOIN q WHERE e.vec_id <> 0)
"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").filter("vec_id <> 0")
    return rows.select("vec_id", F.lit("all").alias("ticker"), F.col("label").cast("string").alias("section"), "label", "embedding")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").filter("vec_id = 0").select(F.lit("q").alias("search_id"), F.lit("all").alias("ticker"), F.col("embedding").alias("vector"))


def _search(spark: SparkSession, sf_dir: str, by_label: bool) -> DataFrame:
    asked = _asked(spark, sf_dir)
    if by_label:
        labels = table(spark, sf_dir, "embeddings").filter("vec_id <> 0").select("label", F.lit("all").alias("ticker")).distinct()
        wanted = labels.join(asked, "ticker").select("search_id", F.col("label").cast("int").alias("ord"), "ticker", F.col("label").cast("string").alias("section"), (F.col("label") % 3 + 1).alias("k"), "vector")
        return retrieval.search(_chunks(spark, sf_dir), wanted, ["vec_id"], 3)
    wanted = asked.select("search_id", F.lit(-1).alias("ord"), "ticker", F.lit(None).cast("string").alias("section"), F.lit(5).alias("k"), "vector")
    return retrieval.search(_chunks(spark, sf_dir), wanted, ["vec_id"], 5)


@register(
    "knn_first_wins_union",
    f"""
WITH {_SCORED},
a AS (SELECT vec_id, label, sim, 0 AS branch, row_number() OVER (ORDER BY sim DESC, vec_id) AS rk FROM s),
b AS (SELECT vec_id, label, sim, 1 AS branch, row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) AS rk FROM s),
u AS (SELECT *, rk AS ordr FROM a WHERE rk <= 5 UNION ALL SELECT *, label * 1000 + rk FROM b WHERE rk <= label % 3 + 1),
o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY branch, ordr) AS once FROM u)
SELECT CAST(row_number() OVER (ORDER BY branch, ordr) AS INTEGER) AS n, vec_id, label, round(sim, 6) AS similarity FROM o WHERE once = 1
""",
)
def knn_first_wins_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = _search(spark, sf_dir, False)
    grouped = _search(spark, sf_dir, True).withColumn("rank", F.col("ord") * 1000 + F.col("rank"))
    united = retrieval.first_wins([pooled, grouped], "search_id", ("vec_id",))
    return united.select("n", "vec_id", "label", F.round("similarity", 6).alias("similarity"))


@register(
    "knn_topk",
    f"WITH {_SCORED} SELECT CAST(row_number() OVER (ORDER BY sim DESC, vec_id) AS INTEGER) AS rank, vec_id, label, round(sim, 6) AS similarity FROM s ORDER BY sim DESC, vec_id LIMIT 5",
)
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, False).select("rank", "vec_id", "label", F.round("similarity", 6).alias("similarity"))


@register(
    "knn_quota_by_group",
    f"""
WITH {_SCORED}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT label, rank, vec_id, round(sim, 6) AS similarity FROM r WHERE rank <= label % 3 + 1
""",
)
def knn_quota_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, True).select("label", "rank", "vec_id", F.round("similarity", 6).alias("similarity"))


@register("store_lookup", "SELECT doc_id, n_chars FROM documents WHERE source = 'src1' AND lang = 'en'")
def store_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.lookup(table(spark, sf_dir, "documents"), {"source": "src1", "lang": "en"}, ["doc_id", "n_chars"])


@register("tickers_with_documents", "SELECT n_nationkey, n_name AS ticker FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey)")
def tickers_with_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pins = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("ticker"))
    chunks = table(spark, sf_dir, "supplier").join(pins.select(F.col("n_nationkey").alias("s_nationkey"), "ticker"), "s_nationkey").select("ticker")
    return store.tickers_with_documents(pins, chunks)


def _sourced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by nation: suppliers, some of them as Item 7A."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").cast("string").alias("ticker"),
        F.when(F.col("s_suppkey") % 5 == 0, "7A").otherwise("8").alias("section"),
        F.when(F.col("s_suppkey") % 2 == 0, "own").otherwise("short_unresolved").alias("content_source"),
        F.col("s_suppkey").alias("chunk_index"),
    )


_SOURCES_SQL = """
t AS (SELECT DISTINCT CAST(n_nationkey AS VARCHAR) AS ticker FROM nation),
a AS (
  SELECT CAST(s_nationkey AS VARCHAR) AS ticker, arg_min(CASE WHEN s_suppkey % 2 = 0 THEN 'own' ELSE 'short_unresolved' END, s_suppkey) AS content_source
  FROM supplier WHERE s_suppkey % 5 = 0 GROUP BY 1),
src AS (SELECT t.ticker, a.content_source FROM t LEFT JOIN a USING (ticker))
"""


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("ticker"))


@register("item_7a_sources", f"WITH {_SOURCES_SQL} SELECT ticker, content_source FROM src")
def item_7a_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.item_7a_sources(_sourced(spark, sf_dir), _nations(spark, sf_dir))


def _quota_values() -> str:
    from lodestrata.constants import CATEGORY_QUERIES, CATEGORY_QUOTAS, EXTRA_SEARCHES

    rows = []
    for category, quotas in CATEGORY_QUOTAS.items():
        for no, wanted in enumerate([quotas] + ([EXTRA_SEARCHES[category][1]] if category in EXTRA_SEARCHES else [])):
            query = CATEGORY_QUERIES[category] if no == 0 else EXTRA_SEARCHES[category][0]
            rows += [f"('{category}', {no}, '{query}', '{s}', {i}, {k})" for i, (s, k) in enumerate(wanted.items())]
    return ", ".join(rows)


@register(
    "section_quotas",
    f"""
WITH {_SOURCES_SQL},
qt(category, search_no, query, section, sec_ord, k) AS (VALUES {_quota_values()}),
u AS (
  SELECT ticker, qt.* FROM src CROSS JOIN qt
  UNION ALL SELECT ticker, category, 0, query, '7', 99, 2 FROM src CROSS JOIN (SELECT DISTINCT category, query FROM qt WHERE section = '7A' AND search_no = 0)
  WHERE content_source IS NULL OR content_source = 'short_unresolved'),
g AS (SELECT ticker, category, search_no, query, section, min(sec_ord) AS o, CAST(max(k) AS INTEGER) AS k FROM u GROUP BY ALL)
SELECT ticker, category, CAST(search_no AS INTEGER) AS search_no, query, section,
  CAST(row_number() OVER (PARTITION BY ticker, category, search_no ORDER BY o) - 1 AS INTEGER) AS sec_ord, k FROM g
""",
)
def section_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = retrieval.item_7a_sources(_sourced(spark, sf_dir), _nations(spark, sf_dir))
    return retrieval.section_quotas(sources)


@register(
    "read_from",
    """
WITH r AS (SELECT o_custkey, o_orderstatus AS section, o_orderkey AS n FROM orders),
c AS (SELECT o_custkey, section, count(*) AS times, min(n) AS first FROM r GROUP BY ALL)
SELECT o_custkey, string_agg('Item ' || section || ' ×' || times, ', ' ORDER BY first) AS read_from FROM c GROUP BY o_custkey
""",
)
def read_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    retrieved = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderstatus").alias("section"), F.col("o_orderkey").alias("n"))
    return retrieval.read_from(retrieved, ["o_custkey"])


@register(
    "statement_chunks",
    """
SELECT CAST(l_suppkey AS VARCHAR) AS ticker, l_orderkey * 10 + l_linenumber AS chunk_index,
  CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber) AS INTEGER) AS rank
FROM (SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber, l_returnflag FROM lineitem) WHERE l_returnflag = 'R'
""",
)
def statement_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag").distinct()
    chunks = rows.select(F.col("l_suppkey").cast("string").alias("ticker"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_index"), F.when(F.col("l_returnflag") == "R", "income").otherwise("").alias("statement"))
    return retrieval.statement_chunks(chunks, "income").select("ticker", "chunk_index", "rank")
