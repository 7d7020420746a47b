"""Filtered top-k search, quotas by Item, and ordered unions in which the first occurrence wins.

Searches are a stated set of rows: search_id, ord (order within a question), ticker, section (null: any),
k, vector. Up to MOST_SEARCHES of them are broadcast, so that chunks are scanned in place; more are joined
by ticker. Either way each task keeps the best k of a search before anything is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.constants import (
    ANSWER_K, ANSWER_STATEMENTS_K, BALANCE_PASSAGE_INDEX, BALANCE_SHEET, CATEGORY_QUERIES, CATEGORY_QUOTAS, EXTRA_SEARCHES, INCOME, SCALE_PASSAGE_INDEX,
    SHORT_UNRESOLVED, UNRESOLVED_7A_K,
)
from lodestrata.functions.text import raw_lines
from lodestrata.operators.statements import cash_debt_texts, scale_texts

MOST_SEARCHES = 4096
CHUNK_KEY = ("accession", "section", "chunk_index")


def similarity(a: Column, b: Column) -> Column:
    """The inner product in double precision, summed in order."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0).cast("double"), lambda total, x: total + x)


def broadcast_few(rows: DataFrame, column: str, most: int = MOST_SEARCHES) -> DataFrame:
    """rows, broadcast if there are no more than `most` of them; counting stops there."""
    return F.broadcast(rows) if len(rows.select(column).limit(most + 1).collect()) <= most else rows


def best(scored: DataFrame, by: list[str], k: Column | int, most: int, order: list[Column]) -> DataFrame:
    """The first k rows of each group with `rank` (from 1). `most` bounds k by a literal, so that the planner
    keeps no more rows a group and task before the exchange."""
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.filter((F.col("rank") <= k) & (F.col("rank") <= most))


def search(chunks: DataFrame, searches: DataFrame, tie: list[str], most: int, vector: str = "embedding") -> DataFrame:
    """search_id, ord, rank, similarity and the chunk's columns: the k nearest chunks of each search, from its
    ticker and section only. Ties go to the smaller key."""
    wanted = searches.select("search_id", "ord", "ticker", F.col("section").alias("_section"), "k", F.col("vector").alias("_vector"))
    wanted = broadcast_few(wanted, "search_id")
    met = chunks.join(wanted, "ticker").filter(F.col("_section").isNull() | (F.col("_section") == F.col("section")))
    scored = met.withColumn("similarity", similarity(F.col(vector), F.col("_vector")))
    found = best(scored, ["search_id", "ord"], F.col("k"), most, [F.col("similarity").desc(), *map(F.col, tie)])
    return found.drop("_section", "_vector", "k", vector)


def first_wins(branches: list[DataFrame], by: str, key: tuple[str, ...] = CHUNK_KEY) -> DataFrame:
    """The union of branches (each with `rank`) by branch and rank, each key once, where it comes first;
    n numbers what is left from 1."""
    parts = [b.withColumn("_branch", F.lit(i)) for i, b in enumerate(branches)]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    own = Window.partitionBy(by, *key).orderBy("_branch", "rank")
    once = union.withColumn("_once", F.row_number().over(own)).filter("_once = 1")
    return once.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy("_branch", "rank"))).drop("_branch", "_once", "rank")


def statement_chunks(chunks: DataFrame, statement: str) -> DataFrame:
    """The chunks of a primary statement with `rank` in document order within their ticker."""
    return chunks.filter(F.col("statement") == statement).withColumn("rank", F.row_number().over(Window.partitionBy("ticker").orderBy("chunk_index")))


def retrieve_for_questions(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """question_id, n and the chunk's columns for each of questions (question_id, ticker, vector): the best of
    the filing, the best of Item 8, and the whole income statement, without repeats."""
    asked = questions.select(F.col("question_id").alias("search_id"), "ticker", "vector")
    branches = []
    for ord_, (section, k) in enumerate(((None, ANSWER_K), ("8", ANSWER_STATEMENTS_K))):
        searches = asked.select("search_id", F.lit(ord_).alias("ord"), "ticker", F.lit(section).cast("string").alias("section"), F.lit(k).alias("k"), "vector")
        branches.append(search(chunks, searches, list(CHUNK_KEY), k).drop("ord", "similarity"))
    income = statement_chunks(chunks, INCOME).drop("embedding").join(asked.select("search_id", "ticker"), "ticker")
    return first_wins([*branches, income], "search_id").withColumnRenamed("search_id", "question_id")


def item_7a_sources(chunks: DataFrame, tickers: DataFrame) -> DataFrame:
    """ticker, content_source: how each ticker's Item 7A was come by, null if it has none."""
    found = chunks.filter(F.col("section") == "7A").groupBy("ticker").agg(F.min_by("content_source", "chunk_index").alias("content_source"))
    return tickers.select("ticker").distinct().join(found, "ticker", "left")


def _quota_rows() -> list[tuple]:
    rows = []
    for category, quotas in CATEGORY_QUOTAS.items():
        searches = [(CATEGORY_QUERIES[category], quotas)] + ([EXTRA_SEARCHES[category]] if category in EXTRA_SEARCHES else [])
        rows += [(category, no, query, section, i, k) for no, (query, wanted) in enumerate(searches) for i, (section, k) in enumerate(wanted.items())]
    return rows


_QUOTA = ("category", "search_no", "query", "section", "sec_ord", "k")


def quota_table(spark: SparkSession) -> DataFrame:
    """category, search_no (0: the main one), query, section, sec_ord, k."""
    return spark.createDataFrame(_quota_rows(), "category string, search_no int, query string, section string, sec_ord int, k int")


def section_quotas(sources: DataFrame) -> DataFrame:
    """ticker, category, search_no, query, section, sec_ord, k for each ticker of sources (ticker, content_source).
    Where Item 7A is missing or unresolved, main searches that read it read Item 7 as well, last if it is new.
    The catalogue of quotas is a constant: each ticker's row is exploded in place, without a join."""
    lacking = F.coalesce(F.col("content_source") == SHORT_UNRESOLVED, F.lit(True))
    rows = _quota_rows()
    extra = [(c, 0, query, "7", 99, UNRESOLVED_7A_K) for c, no, query, section, _, _ in rows if section == "7A" and no == 0]
    literal = lambda rs: F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(_QUOTA, r, strict=True)]) for r in rs])
    each = sources.select("ticker", F.inline(F.when(lacking, F.concat(literal(rows), literal(extra))).otherwise(literal(rows))))
    joined = each.groupBy("ticker", "category", "search_no", "query", "section").agg(F.min("sec_ord").alias("sec_ord"), F.max("k").alias("k"))
    return joined.withColumn("sec_ord", (F.row_number().over(Window.partitionBy("ticker", "category", "search_no").orderBy("sec_ord")) - 1).cast("int"))


def category_chunks(chunks: DataFrame, quotas: DataFrame, vectors: DataFrame) -> DataFrame:
    """ticker, category, n and the chunk's columns: what each category of each ticker reads, in the order of
    searches and Items, without repeats. vectors: query, vector."""
    searches = quotas.join(broadcast_few(vectors, "query"), "query").select(
        F.concat_ws("\x1f", "ticker", "category").alias("search_id"), (F.col("search_no") * 100 + F.col("sec_ord")).alias("ord"), "ticker", "section", "k", "vector"
    )
    most = max(k for wanted in (*CATEGORY_QUOTAS.values(), *(q for _, q in EXTRA_SEARCHES.values())) for k in wanted.values())
    found = search(chunks, searches, list(CHUNK_KEY), max(most, UNRESOLVED_7A_K))
    ranked = found.withColumn("rank", F.col("ord") * 1000 + F.col("rank")).drop("ord", "similarity")
    kept = first_wins([ranked], "search_id")
    return kept.withColumn("category", F.split("search_id", "\x1f")[1]).drop("search_id")


def read_from(retrieved: DataFrame, by: list[str]) -> DataFrame:
    """by, read_from: "Item 7A ×2, Item 8 ×1" in the order in which the Items first come (section, n)."""
    counted = retrieved.groupBy(*by, "section").agg(F.count("*").alias("times"), F.min("n").alias("first"))
    rows = F.sort_array(F.collect_list(F.struct("first", "section", "times")))
    shown = F.transform(rows, lambda r: F.concat(F.lit("Item "), r["section"], F.lit(" ×"), r["times"].cast("string")))
    return counted.groupBy(*by).agg(F.array_join(shown, ", ").alias("read_from"))


def _statement_text(chunks: DataFrame, statement: str) -> DataFrame:
    """ticker, line_no, text: the lines of a statement's chunks in order; lines that chunks share are repeated."""
    rows = chunks.filter(F.col("statement") == statement).select("ticker", "chunk_index", F.posexplode(raw_lines(F.col("text"))).alias("at", "text"))
    return rows.select("ticker", (F.col("chunk_index").cast("long") * (1 << 20) + F.col("at")).alias("line_no"), "text")


def _derived(chunks: DataFrame, texts: DataFrame, statement: str, index: int) -> DataFrame:
    """A passage that is no stored chunk: the fields of the statement's first chunk, with a text of its own."""
    fields = [c for c in chunks.columns if c not in ("ticker", "text", "chunk_index", "embedding", "chunk_id")]
    first = chunks.filter(F.col("statement") == statement).groupBy("ticker").agg(F.min_by(F.struct(*fields), "chunk_index").alias("_first"))
    return texts.join(first, "ticker").select("ticker", "_first.*", F.lit(index).alias("chunk_index"), "text")


def scale_passages(chunks: DataFrame, pins: DataFrame) -> DataFrame:
    """One passage a ticker: its pinned income rows. Running it raises an error for a pin without just one row."""
    texts = scale_texts(_statement_text(chunks, INCOME), pins, "ticker")
    return _derived(chunks, texts, INCOME, SCALE_PASSAGE_INDEX)


def balance_sheet_passages(chunks: DataFrame) -> DataFrame:
    """One passage a ticker whose balance sheet has cash or debt rows: those rows."""
    return _derived(chunks, cash_debt_texts(_statement_text(chunks, BALANCE_SHEET), "ticker"), BALANCE_SHEET, BALANCE_PASSAGE_INDEX)
