"""Sharding by longest-processing-time scheduling: the law is `bytes`, shards of nearly equal size.

Equal texts form a group that stays together. Groups go by falling size to the least loaded of the
shards, which a heap holds. Groups of equal size are interchangeable, so that the schedule needs only how many
groups there are of each size: a histogram, of at most sqrt(2 * bytes) rows whatever the number of groups (sizes that
differ add up). The groups of a size are dealt through the heap one by one, or, if there are more of them than
shards, by the closed form of the same greedy choice. Each shard then takes as many groups of a size as it was
dealt, in the order of their hashes.

Groups are numbered within their size, and rows within their shard, without gathering either in one task: parts
are numbered by themselves, from where the part before ends. A part of rows is what one task holds of a shard, so that
any number of equal rows is spread over tasks; rows of frequent texts get their shard by broadcast, see common.by_key().

Defined results: a null text has no bytes (size 16, crc 0) and is a group of its own, distinct from the
empty text; ties go to the smaller hash and to the smaller shard; repeated rows are members of the same
group with slots of their own; texts of any length are one member each, and a group larger than a shard's share
makes its shard as large as it is; columns of other names take no part; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import by_key
from lodestrata.session import cut_lineage

SHARDS = 40
OVERHEAD = 16
#: Groups that one task numbers, on average.
PART_GROUPS = 65_536


def dealt(loads: list[int], size: int, n: int) -> list[int]:
    """How many of n items of one size each shard gets, each item going to the least loaded shard, ties to the smaller."""
    if n <= len(loads):
        heap, out = [(load, s) for s, load in enumerate(loads)], [0] * len(loads)
        heapq.heapify(heap)
        for _ in range(n):
            load, s = heap[0]
            out[s] += 1
            heapq.heapreplace(heap, (load + size, s))
        return out
    # Shard s can take items while it stands at load, load + size, ...: those of the n least such places are taken.
    below = lambda level: [max(0, -((load - level) // size)) for load in loads]
    low, high = min(loads), max(loads) + size * (n // len(loads) + 1)
    while low < high:  # the highest level that at most n places are below
        middle = (low + high + 1) // 2
        low, high = (middle, high) if sum(below(middle)) <= n else (low, middle - 1)
    out = below(low)
    left = n - sum(out)
    for s, load in enumerate(loads):
        if left and load + out[s] * size == low:
            out[s], left = out[s] + 1, left - 1
    return out


def schedule(histogram: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """(size, shard, first, number): the groups of a size that each shard gets, counted from 0; histogram: (size, groups)."""
    loads, out = [0] * shards, []
    for size, n in sorted(histogram, reverse=True):
        first = 0
        for s, k in enumerate(dealt(loads, size, n)):
            if k:
                out.append((size, s, first, k))
                loads[s], first = loads[s] + k * size, first + k
    return out


def _size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def numbered(rows: DataFrame, by: str, part: Column, order: list[str], into: str) -> DataFrame:
    """rows with `into`: their number within `by`, from 0, by part and then by order. A task holds one part of one `by`."""
    parted = rows.withColumn("_part", part)
    counted = parted.groupBy(by, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select(by, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(by, "_part").orderBy(*order)
    return parted.withColumn("_at", F.row_number().over(within) - 1).join(starts, [by, "_part"]).withColumn(into, F.col("_start") + F.col("_at")).drop("_part", "_start", "_at")


def assign(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, shard for each row."""
    rows = docs.select(
        F.col(key),
        _size(F.col(text)).alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.xxhash64(F.col(text))).alias("h"),
    )
    rows = cut_lineage(rows)
    groups = cut_lineage(rows.groupBy("h").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    histogram = dict(zip(*(c.to_pylist() for c in groups.groupBy("bytes").agg(F.count("*").alias("k")).toArrow().columns), strict=True))
    parts = max(1, math.ceil(sum(histogram.values()) / PART_GROUPS))
    ranked = numbered(groups, "bytes", F.pmod(F.xxhash64("h"), F.lit(parts)).cast("int"), ["h"], "_rank")
    # What is left to tell groups of one size apart by is their rank: a size's row holds how many groups each shard takes, one after another.
    planned: dict[int, list[list[int]]] = {}
    for size, shard, _, k in schedule(list(histogram.items()), shards):
        planned.setdefault(size, [[], []])[0].append(shard)
        planned[size][1].append(k)
    table = docs.sparkSession.createDataFrame(pa.table({
        "bytes": pa.array(planned, pa.int64()), "shards": pa.array([x for x, _ in planned.values()], pa.list_(pa.int32())),
        "takes": pa.array([x for _, x in planned.values()], pa.list_(pa.int64())), "k": pa.array([histogram[size] for size in planned], pa.int64()),
    }))
    through = F.transform("takes", lambda _, i: F.aggregate(F.slice("takes", 1, i + 1), F.lit(0).cast("long"), lambda a, x: a + x))
    shard = F.get("shards", F.size(F.filter(through, lambda t: t <= F.col("_rank"))))
    placed = by_key(cut_lineage(ranked), table, "bytes", "k").withColumn("shard", shard)
    return by_key(rows, cut_lineage(placed.select("h", "shard", "n")), "h", "n").select(key, "size", "text_crc32", "shard")


def slots(placed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows with slot: gapless from 0 within each shard. placed is what cut_lineage() gave, whose parts don't change."""
    return numbered(placed, "shard", F.spark_partition_id(), [key, "text_crc32", "size"], "slot")


def op4(docs: DataFrame) -> DataFrame:
    placed = slots(cut_lineage(assign(docs)))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
