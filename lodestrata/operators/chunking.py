"""Texts to chunks, within their rows."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.constants import CHUNK_OVERLAP, CHUNK_SIZE, SEPARATORS


def split_text(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Chunks of at most `size` characters, cut at the first of the separators that the text has, and where a
    piece is still too long, at the next ones. A separator stays with the piece after it; neighbouring chunks
    share up to `overlap` characters of whole pieces; chunks are stripped and never empty."""
    at = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    out: list[str] = []
    fitting: list[str] = []
    for piece in _pieces(text, separators[at]):
        if len(piece) < size:
            fitting.append(piece)
            continue
        out += _packed(fitting, size, overlap)
        fitting = []
        rest = separators[at + 1 :]
        out += split_text(piece, size, overlap, rest) if rest else [piece]
    return out + _packed(fitting, size, overlap)


def _pieces(text: str, separator: str) -> list[str]:
    if not separator:
        return list(text)
    first, *others = text.split(separator)
    return [p for p in (first, *(separator + o for o in others)) if p]


def _packed(pieces: list[str], size: int, overlap: int) -> list[str]:
    out: list[str] = []
    held: deque[str] = deque()
    length = 0
    for piece in pieces:
        if length + len(piece) > size and held:
            out.append("".join(held).strip())
            while length > overlap or (length and length + len(piece) > size):
                length -= len(held.popleft())
        held.append(piece)
        length += len(piece)
    out.append("".join(held).strip())
    return [c for c in out if c]


def chunk_parts(sections: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, parts: str = "parts") -> DataFrame:
    """The sections with chunk_index, statement and text of each of their chunks in place of their parts
    (array<struct<part_no, statement, text>>). The index runs across the parts of a section."""
    kept = [c for c in sections.columns if c not in (parts, "text", "statement", "chunk_index")]
    rows = sections.select(*kept, parts)
    chunk = pa.list_(pa.struct([("chunk_index", pa.int32()), ("statement", pa.string()), ("text", pa.string())]))
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("chunks", T._parse_datatype_string("array<struct<chunk_index: int, statement: string, text: string>>"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                made = []
                for value in part.column(len(kept)).to_pylist():
                    cut = [(p["statement"], c) for p in value or [] for c in split_text(p["text"] or "", size, overlap)]
                    made.append([{"chunk_index": i, "statement": s, "text": c} for i, (s, c) in enumerate(cut)])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(made, chunk)], names=[*kept, "chunks"])

    return rows.mapInArrow(run, schema).select(*kept, F.inline("chunks"))


def recursive_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """key, chunk_index, text: the chunks of each text; none of null and blank texts."""
    part = F.array(F.struct(F.lit(0).alias("part_no"), F.lit("").alias("statement"), F.col(text).alias("text")))
    return chunk_parts(docs.select(key, part.alias("parts")), size, overlap).select(key, "chunk_index", "text")


def stride_chunks(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """array<string>: windows of `size` characters, each `overlap` into the one before; JVM expressions only."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - overlap) / step).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(size)))


def fixed_stride_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """key, chunk_index, text by a fixed stride; none of null and empty texts."""
    rows = docs.filter(F.length(text) > 0)
    return rows.select(key, F.posexplode(stride_chunks(F.col(text), size, overlap)).alias("chunk_index", "text"))


def chunk_counts(chunks: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """A row for each value of `row`: the number of chunks under each value of `column`, 0 if none, under `other` that of all other
    values and of none, and `total`, of all."""
    each = [F.count_if(F.col(column) == v).alias(v) for v in values]
    other = F.count_if(~F.coalesce(F.col(column).isin(*values), F.lit(False))).alias("other")
    return chunks.groupBy(row).agg(*each, other, F.count(F.lit(1)).alias("total"))
