"""Filings to the chunk store: parse, section, validate, chunk, embed, write."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.constants import CHUNK_OVERLAP, CHUNK_SIZE, INCOME, KEPT_ITEMS
from lodestrata.operators.chunking import chunk_counts, chunk_parts
from lodestrata.operators.embedding import Embedder, HashingEmbedder, with_embeddings
from lodestrata.operators.html_lines import html_lines
from lodestrata.operators.sections import split_sections
from lodestrata.operators.statements import scale_matches, sections_with_parts, statement_lines
from lodestrata.sources import store

PIN_FIELDS = ("ticker", "company", "cik", "form", "fiscal_year", "period_end", "accession", "source_url")


class IngestError(ValueError):
    """The filings can't be stored as they are."""


def sections_of(filings: DataFrame, key: str = "accession", html: str = "html") -> DataFrame:
    """key, section, title, text, content_source, resolved_from of filings (key, html)."""
    return split_sections(html_lines(filings, key, html), key)


def chunk_filings(pins: DataFrame, sections: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """chunk_id, the pin's fields and the section's, statement, chunk_index and text of each chunk. Pins are one
    row a filing; ids are the same whenever the filing is."""
    parted = sections_with_parts(sections.withColumnRenamed("title", "section_title"), "accession").drop("text")
    chunks = chunk_parts(parted, size, overlap).join(pins.select(*PIN_FIELDS), "accession")
    made = chunks.withColumn("chunk_id", F.concat_ws(":", "accession", "section", "chunk_index"))
    return made.select("chunk_id", *PIN_FIELDS, "section", "section_title", "content_source", "resolved_from", "statement", "chunk_index", "text")


def ingest_problems(pins: DataFrame, sections: DataFrame) -> DataFrame:
    """ticker, problem: filings that are not there, and pinned rows that name no row or several of the income statement."""
    there = sections.select("accession").distinct()
    missing = pins.join(there, "accession", "left_anti").select("ticker", F.lit("no sections: not fetched, or not parsed").alias("problem"))
    eight = statement_lines(sections.filter(F.col("section") == "8"), "accession").filter(F.col("statement") == INCOME)
    wrong = scale_matches(eight, pins.join(there, "accession", "left_semi"), "accession").filter("n_matches <> 1")
    told = F.concat(F.col("n_matches").cast("string"), F.lit(" income-statement rows labelled '"), "label", F.lit("'"))
    return missing.union(wrong.join(pins.select("accession", "ticker"), "accession").select("ticker", told.alias("problem")))


def ingest(pins: DataFrame, filings: DataFrame, path: str, make: Callable[[], Embedder] = HashingEmbedder, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Rebuild the store at path from filings (accession, html), or leave it untouched and raise IngestError.
    Returns the counts of chunks by ticker and Item. Texts are parsed once: sections are written first."""
    from lodestrata.session import cut_lineage

    sections = cut_lineage(sections_of(filings))
    problems = ingest_problems(pins, sections).limit(20).collect()
    if problems:
        raise IngestError("; ".join(f"{r['ticker']}: {r['problem']}" for r in problems))
    store.write_chunks(with_embeddings(chunk_filings(pins, sections, size, overlap), make), path)
    return ingest_counts(store.read_chunks(pins.sparkSession, path))


def ingest_counts(chunks: DataFrame) -> DataFrame:
    return chunk_counts(chunks, "ticker", "section", KEPT_ITEMS)
