"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is a share of the total by weight, capped at a multiple of its own size. Each of its
documents is wanted target/size times: so many whole copies, and a fraction that is rounded to 0 or 1.
Rounding takes two fractional documents at a time and moves words from one to the other, at random in
one of the two directions with the chances that keep both expectations, until one is integral. The words
of the pair never change in sum. The last document of a source that is still fractional is rounded by its own chance, so that
every document is taken as often as it is wanted on average, and a source misses its target by less than that one document;
as documents meet in the order of their lengths, the longest first, the last one is short as a rule.

Rows that are alike are one document with a number: m of them are wanted m times as often, so many whole copies and
one fraction, and are given their copies evenly. Documents are dealt by hash into blocks; each block is rounded in one task and
leaves one fractional document at most. These residuals are combined in the same way, FAN blocks at a time, in a tree.

Chances come from hashes of the documents' ids, sources and texts, so that reruns agree. Defined results: a null text and
a blank one have no words and are never taken; null is a source of its own, the last one; repeated rows are documents
with copies of their own, evenly given; documents of one length meet in the order of their hashes; texts are counted whole, at
any length; columns of other names take no part and pass through repeated(); an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import word_count
from lodestrata.session import cut_lineage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BLOCK_ROWS, FAN = 1024, 256
#: Most sources whose table is broadcast; more of them are joined by key.
BROADCAST_SOURCES = 50_000
EPS = 1e-9


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """The targets of sources in order: shares of `share` times the total by weight, capped, the excess dealt anew by weight.

    Sources reach their caps in the order of cap to weight, so that one pass in this order finds those that do."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    caps, left, free = [most * s for s in sizes], share * sum(sizes), sum(weight)
    out = [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: caps[i] / weight[i])
    for n, i in enumerate(order):
        if caps[i] * free >= left * weight[i]:  # neither this one nor any later reaches its cap
            for j in order[n:]:
                out[j] = left * weight[j] / free
            break
        out[i], left, free = caps[i], left - caps[i], free - weight[i]
    return out


def _uniform(a: int, b: int, salt: int) -> float:
    """A number in [0, 1) from a pair, in any order of calls the same."""
    x = (int(a) * 0x9E3779B97F4A7C15 + int(b) * 0xC2B2AE3D27D4EB4F + salt * 0x165667B19E3779F9) & 0xFFFFFFFFFFFFFFFF
    for _ in range(2):
        x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    return (x >> 11) / (1 << 53)


def pivotal(sizes: np.ndarray, chances: np.ndarray, ids: np.ndarray, salt: int) -> tuple[np.ndarray, int]:
    """Rounded chances, and the position of the one still fractional (-1 if none)."""
    x = chances.astype(float).copy()
    held = -1
    for j in range(len(x)):
        if x[j] <= EPS or x[j] >= 1 - EPS or sizes[j] == 0:
            x[j] = 0.0 if sizes[j] == 0 else round(x[j])
            continue
        if held < 0:
            held = j
            continue
        a, b = float(sizes[held]), float(sizes[j])
        # Words moved from j to the held document, and the other way, until one of the two is integral.
        up, down = min(a * (1 - x[held]), b * x[j]), min(a * x[held], b * (1 - x[j]))
        moved = up if _uniform(ids[held], ids[j], salt) < down / (up + down) else -down
        x[held] += moved / a
        x[j] -= moved / b
        loose = [i for i in (held, j) if EPS < x[i] < 1 - EPS]
        for i in (held, j):
            if i not in loose:
                x[i] = round(x[i])
        held = loose[0] if loose else -1
    return x, held


def settled(chance: float, key: int, salt: int) -> float:
    """The last fractional document of a source, rounded by its chance."""
    return 1.0 if _uniform(key, ~int(key), salt + 7919) < chance else 0.0


def _rounded(salt: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        # Long documents first: what is left fractional in the end is then a short one as a rule.
        group = group.sort_values(["size", "h"], ascending=[False, True], kind="stable").reset_index(drop=True)
        ids = group["h"].to_numpy()
        x, held = pivotal(group["size"].to_numpy(), group["x"].to_numpy(), ids, salt)
        if held >= 0 and group["blocks"].iloc[0] <= FAN**salt:
            x[held], held = settled(x[held], ids[held], salt), -1
        group["x"] = x
        group["loose"] = np.arange(len(group)) == held
        return group

    return run


def source_table(spark: SparkSession, sizes: DataFrame) -> DataFrame:
    """source, source_size, target, ratio, blocks: one row per source; the sources are a catalogue, held by the driver."""
    rows = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("size"), F.count("*").alias("n")).collect()
    rows = sorted(rows, key=lambda r: (r["source"] is None, r["source"] or ""))
    goal = targets([r["size"] for r in rows])
    data = [(r["source"], r["size"], t, t / r["size"] if r["size"] else 0.0, math.ceil(r["n"] / BLOCK_ROWS)) for r, t in zip(rows, goal, strict=True)]
    table = spark.createDataFrame(data, "source string, source_size long, target double, ratio double, blocks int")
    return F.broadcast(table) if len(data) <= BROADCAST_SOURCES else table


def mix(docs: DataFrame, key: str = "doc_id", identity: Column | None = None) -> DataFrame:
    """key, source, size, source_size, target, m, copies, h: a row for each kind of row of docs (text, source), with the number m
    of rows of the kind and the copies of all of them together. Rows of one identity (a long; a hash of key, source and
    text by default), are of one kind."""
    spark = docs.sparkSession
    identity = F.xxhash64(key, "source", "text") if identity is None else identity
    each = docs.select(F.col(key), F.col("source"), word_count(F.col("text")).alias("size"), identity.alias("h"))
    sized = cut_lineage(each.groupBy(key, "source", "size", "h").agg(F.count("*").alias("m")))
    sources = source_table(spark, sized)
    named = sized.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    wanted = F.col("ratio") * F.col("m")
    rows = named.select(
        F.col(key), "source", "size", "source_size", "target", "h", "m",
        F.floor(wanted).cast("long").alias("whole"),
        (wanted - F.floor(wanted)).alias("x"),
        "blocks",
        F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int").alias("block"),
    )
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, source string, size long, source_size long, target double, h long, m long, whole long, x double, blocks int, block int, loose boolean"
    level = cut_lineage(rows.groupBy("source", "block").applyInPandas(_rounded(0), schema))
    done = level.filter(~F.col("loose"))
    loose = level.filter("loose")
    # The tree: each round joins FAN blocks of a source, and settles all but one residual of them.
    blocks = sources.agg(F.max("blocks")).first()[0] or 0
    salt = 0
    while blocks > 1:
        blocks, salt = math.ceil(blocks / FAN), salt + 1
        joined = loose.drop("loose").withColumn("block", F.floor(F.col("block") / FAN).cast("int"))
        level = cut_lineage(joined.groupBy("source", "block").applyInPandas(_rounded(salt), schema))
        done = done.union(level.filter(~F.col("loose")))
        loose = level.filter("loose")
    return done.select(key, "source", "size", "source_size", "target", "m", (F.col("whole") + F.col("x").cast("long")).alias("copies"), "h")


def op3(docs: DataFrame) -> DataFrame:
    """The copies of rows that are alike are given to them evenly, one more to the first."""
    kinds = mix(docs).withColumn("_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    copies = F.floor(F.col("copies") / F.col("m")) + F.when(F.col("_n") < F.col("copies") % F.col("m"), 1).otherwise(0)
    return kinds.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"))


def repeated(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns it came with.

    Rows that are alike in all columns are one kind, which is reduced to a row within each task before it is dealt out."""
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    rows = docs.select(row.alias("_row"), F.xxhash64(*[F.col(f"`{c}`") for c in names]).alias("_h")).dropDuplicates(["_h"])
    taken = mix(docs, identity=F.xxhash64(*[F.col(f"`{c}`") for c in names])).filter("copies > 0").select(F.col("h").alias("_h"), "copies")
    out = rows.join(taken, "_h").select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(*[F.col("_row").getField(c).alias(c) for c in names])
