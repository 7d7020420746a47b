"""A file stream of filings to chunks: each file is parsed once, whatever the number of restarts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestrata.operators.embedding import Embedder, HashingEmbedder, with_embeddings
from lodestrata.operators.ingest import chunk_filings, sections_of

_FILE = "path string, modificationTime timestamp, length long, content binary"


def arriving_filings(spark: SparkSession, root: str, files_at_once: int = 64) -> DataFrame:
    """accession, html of the files under root, as a stream."""
    files = spark.readStream.format("binaryFile").schema(_FILE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_at_once).load(root)
    return files.select(F.element_at(F.split("path", "/"), -2).alias("accession"), F.col("content").alias("html"))


def ingest_arrivals(pins: DataFrame, root: str, path: str, checkpoint: str, make: Callable[[], Embedder] = HashingEmbedder) -> StreamingQuery:
    """Add the chunks of all files that are there to the store at path, and end. A filing's chunks are a partition of their own:
    a batch that is run again, and a filing that arrives again, replaces what there was of it, so that no chunk is stored twice."""
    spark = pins.sparkSession

    def add(batch: DataFrame, number: int) -> None:
        chunks = with_embeddings(chunk_filings(pins, sections_of(batch)), make)
        chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ticker", "accession").parquet(path)

    return arriving_filings(spark, root).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
