"""HTML documents to lines: one Arrow pass, no shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.operators.html_parser import parse_lines

LINE = "array<struct<text: string, heading_size: double>>"
_ARROW_LINE = pa.list_(pa.struct([("text", pa.string()), ("heading_size", pa.float64())]))


def with_lines(docs: DataFrame, html: str = "html") -> DataFrame:
    """docs with `lines` in place of the html column (binary or string)."""
    kept = [c for c in docs.columns if c != html]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("lines", T._parse_datatype_string(LINE))])
    at, keep_at = docs.columns.index(html), [docs.columns.index(c) for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 64):  # documents are large: few at a time
                part = batch.slice(low, 64)
                made = [[{"text": t, "heading_size": s} for t, s in parse_lines(x.as_py())] for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep_at), pa.array(made, _ARROW_LINE)], names=[*kept, "lines"])

    return docs.mapInArrow(run, schema)


def html_lines(docs: DataFrame, key: str = "doc_id", html: str = "html") -> DataFrame:
    """key, line_no (from 0), text, heading_size for each line of each document."""
    return with_lines(docs.select(key, html), html).select(key, F.posexplode("lines").alias("line_no", "line")).select(key, "line_no", "line.text", "line.heading_size")
