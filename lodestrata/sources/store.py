"""The chunk store: Parquet, in each file by ticker."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Rebuild the store; nothing of an earlier one stays. Each task writes one file, however many the tickers; rows are sorted by
    ticker in it, so that a look-up of one ticker reads the pages that their bounds leave."""
    chunks.sortWithinPartitions("ticker").write.mode("overwrite").parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def lookup(chunks: DataFrame, where: dict[str, object], columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Rows whose fields equal the given values; conditions, columns and limit all reach the scan."""
    for name, value in where.items():
        chunks = chunks.filter(F.col(name) == value)
    chunks = chunks.select(*columns) if columns else chunks
    return chunks if limit is None else chunks.limit(limit)


def has_documents(chunks: DataFrame, ticker: str | None = None) -> bool:
    return not lookup(chunks, {"ticker": ticker} if ticker else {}, ["ticker"], 1).isEmpty()


def tickers_with_documents(pins: DataFrame, chunks: DataFrame) -> DataFrame:
    return pins.join(chunks.select("ticker"), "ticker", "left_semi")


def digest(chunks: DataFrame) -> str:
    """Ten hex digits that tell stores of different chunks apart, in whatever order the rows come: sums and
    exclusive ors of row hashes are worked out map-side, and one small row is left."""
    row = F.struct(*[F.col(c) for c in sorted(chunks.columns) if c != "embedding"])
    h = F.xxhash64(F.to_json(row))
    high, low = F.shiftright(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF))
    total = chunks.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("x"), F.coalesce(F.sum(high.cast("decimal(38,0)")), F.lit(0)).alias("a"), F.coalesce(F.sum(low.cast("decimal(38,0)")), F.lit(0)).alias("b"))
    return total.select(F.substring(F.sha2(F.concat_ws(":", "n", "x", "a", "b"), 256), 1, 10)).first()[0]


def load_or_build(spark: SparkSession, chunks: DataFrame, root: str, setting: str, embed: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, bool]:
    """The store of these chunks under root, and whether it was there. Its name carries their digest, so that
    other chunks never find it."""
    path = f"{root.rstrip('/')}/{setting}_{digest(chunks)}"
    try:
        kept = read_chunks(spark, path)
        if has_documents(kept):
            return kept, True
    except AnalysisException:
        pass  # no such store yet
    write_chunks(embed(chunks), path)
    return read_chunks(spark, path), False
