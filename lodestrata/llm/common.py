"""Shared definitions: words, table access and bounded row batches for Python workers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that parts words, as a Java character class; the same bytes that bytes.split() parts at.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: Column | str = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_array(text: Column) -> Column:
    """Words of a text, in order; an empty array for null or blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


#: A key of more than one in so many rows is one of fewer than so many keys.
HOT_PARTS = 4096


def by_key(rows: DataFrame, table: DataFrame, key: str, times: str) -> DataFrame:
    """rows joined with table, which has a row for each of their keys (never null) and in `times` how many rows have it.

    Keys of more than 1/HOT_PARTS of the rows, fewer than HOT_PARTS therefore, are broadcast, so that no task gets
    all rows of a frequent key; the others are joined by key. Both frames are read twice."""
    total = table.agg(F.coalesce(F.sum(times), F.lit(0))).first()[0]
    hot = F.col(times) * HOT_PARTS > F.lit(total)
    frequent, rest = table.filter(hot).drop(times), table.filter(~hot).drop(times)
    others = rows.join(F.broadcast(frequent.select(key)), key, "left_anti").join(rest, key)
    return rows.join(F.broadcast(frequent), key).unionByName(others)


def flushed(rows: Iterator[tuple], schema: pa.Schema, most: int = 2048) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of a bounded number of rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class Remembered(dict):
    """key -> make(key), for at most 2 * most entries: a full generation becomes the old one, and what is
    used again moves to the new one. What make() gives is never affected, only how often it runs."""

    def __init__(self, make: Callable, most: int, longest: int):
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
