"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints that differ in at most MAX_BITS = 2 bits differ in at most 2 of their 8 bytes, so they share
6 positional bytes at least. Postings of single bytes would be as long as the corpus / 256; the index is
therefore keyed by four positional bytes at once, in the 14 ways BLOCKS, which hold any three byte positions just
once together. Two fingerprints that share 4 or 5 positional bytes have at most one key in common, those that share 6 have 3,
7 have 7: how many keys a pair has in common tells its shared positional bytes. Pairs are tallied over the
whole index, those with fewer than the guaranteed MIN_HITS = 3 are dropped, and the rest is verified by the
bits that differ.

A posting of more than POSTING fingerprints is not paired up but split by further positional bytes: what shares 6
bytes shares two of the other four, in one of 6 ways at least, and is split once more, if need be, by nibbles of the
last two bytes, of which at most 2 differ in linked fingerprints; that leaves 256 at most. Split postings count for
their own block, so that the tallies stay the same whatever POSTING is. Copies count once: all of this works on
distinct fingerprints. Fingerprints of many documents are joined back by broadcast, see common.by_key().

Defined results: a null text, or one without words, has the fingerprint 0, which is linked like any other.
A null doc_id never is a component_id unless a component has no other. Repeated rows are copies of each
other; of rows alike in id and text dedup() keeps any one. Extra columns pass through dedup() untouched. Very long texts
are fingerprinted whole, in blocks of hashes. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import by_key
from lodestrata.llm.components import components
from lodestrata.session import cut_lineage

SHINGLE, SEED, MAX_BITS = 3, 42, 2
#: The sets of four byte positions whose numbers cancel out: any three positions are in one of them, any two outside of three.
BLOCKS = [b for b in combinations(range(8), 4) if b[0] ^ b[1] ^ b[2] ^ b[3] == 0]
MIN_HITS = 3
#: Most fingerprints of a posting that are paired up without splitting it.
POSTING = 128


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """The majority of each bit over the hashes of the word shingles, repeats included; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, width = b" ".join(words), min(width, len(words))
    ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    starts = [e - len(w) for e, w in zip(ends, words, strict=True)]
    h = xxhash.xxh64_intdigest
    hashes = [h(joined[s:e], seed) for s, e in zip(starts, ends[width - 1 :])]  # noqa: B905
    ones, step = np.zeros(64, dtype=np.int64), 1 << 16
    for low in range(0, len(hashes), step):
        part = np.array(hashes[low : low + step], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """fp (long) of each document, with the columns to keep; text must be among docs' columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([fingerprint(t.as_py()) for t in batch.column(0)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], made], names=[*keep, "fp"])

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select("text", *keep).mapInArrow(run, f"{kept}, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _mask(places: tuple[int, ...], width: int) -> int:
    return sum(((1 << width) - 1) << (width * p) for p in places)


def _nibbles(two: tuple[int, ...]) -> list[int]:
    """Of the four nibbles of two bytes, the masks of each two."""
    return [_mask(n, 4) for n in combinations([2 * two[0], 2 * two[0] + 1, 2 * two[1], 2 * two[1] + 1], 2)]


def ways() -> list[tuple[int, list[tuple[int, list[int]]]]]:
    """For each block its mask, and what its postings are split by: masks of two further bytes, and for each of these masks of two further nibbles."""
    out = []
    for block in BLOCKS:
        others = [p for p in range(8) if p not in block]
        split = [(_mask(block, 8) | _mask(two, 8), [_mask(block, 8) | _mask(two, 8) | m for m in _nibbles(tuple(p for p in others if p not in two))]) for two in combinations(others, 2)]
        out.append((_mask(block, 8), split))
    return out


def _keyed(rows: DataFrame, masks: Column) -> DataFrame:
    """fp, block, way, key for each of an array<struct<block, way, mask>>; way tells the masks apart."""
    each = rows.select("fp", F.inline(masks))
    return each.select("fp", "block", "way", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))


def _listed(block: int, masks: list[tuple[int, int]]) -> Column:
    return F.array(*[F.struct(F.lit(block).alias("block"), F.lit(way).alias("way"), F.lit(_signed(m)).cast("long").alias("mask")) for way, m in masks])


def _parted(postings: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The postings of two to POSTING fingerprints, and the longer ones (None if there are none)."""
    sizes = postings.groupBy("way", "key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = cut_lineage(postings.join(sizes, ["way", "key"]))
    longer = shared.filter(F.col("n") > POSTING)
    return shared.filter(F.col("n") <= POSTING).drop("n"), None if longer.isEmpty() else longer.drop("n")


def hits(distinct: DataFrame) -> DataFrame:
    """a, b, block: the pairs of fingerprints (distinct, column fp) that meet in a posting, a < b; all pairs that share 6 positional
    bytes and differ in at most MAX_BITS bits are among them, for each block of bytes that they share."""
    tree = ways()
    short, longer = _parted(_keyed(distinct, F.array(*[F.struct(F.lit(b).alias("block"), F.lit(b).alias("way"), F.lit(_signed(m)).cast("long").alias("mask")) for b, (m, _) in enumerate(tree)])))
    paired = [short]
    if longer is not None:
        split = F.element_at(F.array(*[_listed(b, [(6 * b + i, m) for i, (m, _) in enumerate(parts)]) for b, (_, parts) in enumerate(tree)]), F.col("way") + 1)
        short, longer = _parted(_keyed(longer, split))
        paired.append(short)
    if longer is not None:
        nibbles = [(b, 6 * b + i, masks) for b, (_, parts) in enumerate(tree) for i, (_, masks) in enumerate(parts)]
        split = F.element_at(F.array(*[_listed(b, [(6 * w + i, m) for i, m in enumerate(masks)]) for b, w, masks in nibbles]), F.col("way") + 1)
        paired.append(_keyed(longer, split))
    met = [p.alias("x").join(p.alias("y"), ["way", "key"]).filter(F.col("x.fp") < F.col("y.fp")).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"), F.col("x.block").alias("block")) for p in paired]
    return reduce(DataFrame.union, met)


def links(distinct: DataFrame) -> DataFrame:
    """a, b, bytes: all pairs of fingerprints (distinct, column fp) within MAX_BITS of each other, and how many positional bytes they share."""
    tallied = hits(distinct).groupBy("a", "b").agg(F.expr("bit_count(bit_or(shiftleft(1, block)))").alias("hits")).filter(F.col("hits") >= MIN_HITS)
    near = tallied.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
    return near.select("a", "b", F.when(F.col("hits") == MIN_HITS, 6).otherwise(7).alias("bytes"))


def classes(fps: DataFrame) -> DataFrame:
    """fp, component_id, root, n for each distinct fingerprint of fps (doc_id, fp): the smallest doc_id of its component, its
    component's least fingerprint and its number of documents."""
    distinct = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    member = components(links(distinct.select("fp"))).select(F.col("u").alias("fp"), "root")
    rooted = distinct.join(member, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    linked = distinct.join(member, "fp").groupBy("root").agg(F.min("first").alias("least"))
    return rooted.join(linked, "root", "left").select("fp", F.coalesce("least", "first").alias("component_id"), "root", "n")


def op5(docs: DataFrame) -> DataFrame:
    fps = cut_lineage(fingerprints(docs, "doc_id"))
    found = by_key(fps, cut_lineage(classes(fps).drop("root")), "fp", "n")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup(docs: DataFrame) -> DataFrame:
    """One document of each component, the one of the smallest doc_id, with the columns it came with."""
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), "doc_id", "text", F.xxhash64("text").alias("_h"))
    fps = cut_lineage(fingerprints(rows.select("doc_id", "text", "_h"), "doc_id", "_h"))
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("_h")))
    # Copies are reduced to one row a fingerprint before the join, so that a large group of them meets in no task.
    first = fps.groupBy("fp").agg(one.alias("one"))
    stay = first.join(classes(fps).select("fp", "root"), "fp").groupBy("root").agg(F.min("one").alias("one")).select(F.coalesce("one.doc_id", F.lit(-(1 << 63))).alias("_id"), F.col("one._h").alias("_h"))
    keyed = rows.select("_row", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_id"), "_h")
    # Repeated rows are reduced within each task before they are dealt out by their key.
    kept = keyed.dropDuplicates(["_id", "_h"]).join(stay, ["_id", "_h"], "left_semi")
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in names])
