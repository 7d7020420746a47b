"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

A text is reduced to its words (ASCII letters and digits, in lower case). Windows of 8, 16, 32 ... words overlap
by three quarters, so that a passage as long as a template lies whole in some window of the template's
class, which is at most about 2.7 times as long. Such a window and its template share at least a quarter of
their five-word shingles, even at the least containment, and each of BANDS one-row bands then agrees with
that chance: all of them miss with a chance below 0.75 ** 64, about 1e-8. Windows that agree in a band are verified once,
by the exact share of the template's shingles that they contain.

Only windows that can match are hashed, by conditions that no text with a match fails: the window has as many of the template's
longer words as the shingles needed must hold, and one of the template's anchors is in it, words whose absence alone would spoil too
many shingles. For templates with more than MOST_ANCHORS of these the text is held against both, and against the length of the shingles needed,
before it is cut into windows.

Built-in expressions only; the joins are with the bands and the shingles of the templates, which are broadcast up to
a stated number of them. Defined results: texts without a match (null and blank ones too) have no row; a license found in
several windows, or in repeated rows of one doc_id, has one row with the highest containment; rows of null doc_id
count as one document; licenses that hold one another are each reported. Very long texts are scanned whole, a window at a time. A template
of any length may be given; one of fewer than five words is an error. Columns of other names take no part; an empty table, or no
templates, gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache, reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE, THRESHOLD = 5, 0.8
BANDS = 64
LEAST_WINDOW = 8
#: Most anchors of a template that windows are chosen by, and the shortest words that count for the others.
MOST_ANCHORS, LONG_WORD = 24, 6
#: Most bands, and most shingles, of templates that are broadcast; more of them are joined by key.
BROADCAST_BANDS, BROADCAST_SHINGLES = 500_000, 2_000_000

TEMPLATES: dict[str, str] = {
    "MIT-short": "Released under the MIT License.",
    "MIT-terms": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction",
    "MIT-warranty": 'The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.',
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0-warranty": 'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "GPL-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-endorsement": "may be used to endorse or promote products derived from this software without specific prior written permission",
    "ISC-terms": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0-short": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-short": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
} | {f"{path.stem}-text": path.read_text(encoding="utf-8") for path in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}


def words(text: str) -> list[str]:
    return re.sub(r"[^A-Za-z0-9]+", " ", text).strip().lower().split()


def shingles(text: str) -> list[str]:
    w = words(text)
    return sorted({" ".join(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)})


def window_of(template: str) -> int:
    """The width of the windows that a template is looked for in."""
    n, width = len(words(template)), LEAST_WINDOW
    while n > width - width // 4 + 1:
        width *= 2
    return width


def spare(template: str) -> int:
    """How many of its shingles a text may lack."""
    n = len(shingles(template))
    return n - math.ceil(THRESHOLD * n)


@lru_cache(maxsize=1024)
def anchors(template: str) -> frozenset[str]:
    """Words of which a text that contains the template to the threshold has one at least: without all of
    them, fewer shingles than needed are left. The longest words first."""
    left, out, gone = shingles(template), set(), 0
    for w in sorted(set(words(template)), key=lambda w: (-len(w), w)):
        if gone > spare(template):
            break
        hit = [s for s in left if w in s.split(" ")]
        if hit:
            out.add(w)
            gone += len(hit)
            left = [s for s in left if s not in hit]
    return frozenset(out)


@lru_cache(maxsize=1024)
def long_words(template: str) -> tuple[tuple[str, ...], int]:
    """The template's longer words, and how many of them a text that contains it to the threshold has at least.

    A shingle's loss is shared among its longer words, so that words that are missing lose as many shingles as their
    shares add up to, at least; what is there must make up for all but the shingles to spare."""
    share: Counter = Counter()
    for s in shingles(template):
        own = {w for w in s.split(" ") if len(w) >= LONG_WORD}
        for w in own:
            share[w] += 1 / len(own)
    need, n = sum(share.values()) - spare(template) - 1e-6, 0
    for _, x in share.most_common():
        if need <= 0:
            break
        need, n = need - x, n + 1
    return tuple(sorted(share)), n


def least_chars(template: str) -> int:
    """The fewest letters and digits of a text that contains the template to the threshold: a character is in SHINGLE shingles at most."""
    sizes = sorted(len(s) - SHINGLE + 1 for s in shingles(template))
    return sum(sizes[: len(sizes) - spare(template)]) // SHINGLE


def checked(templates: dict[str, str]) -> dict[str, str]:
    for name, t in templates.items():
        if len(words(t)) < SHINGLE:
            raise ValueError(f"template {name} has fewer than {SHINGLE} words")
    return templates


def _minhashes(hashes: Column) -> Column:
    """The bands: the least of each of BANDS rehashes of the shingles' hashes."""
    rehash = lambda b: lambda h: F.xxhash64(h, F.lit(b))
    return F.array(*[F.array_min(F.transform(hashes, rehash(b))) for b in range(BANDS)])


def _shingle_texts(ws: Column) -> Column:
    n = F.size(ws) - (SHINGLE - 1)
    return F.when(n >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(ws, i, SHINGLE), " ")))).otherwise(F.array().cast("array<string>"))


def _word_array(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(F.lower(plain), " "))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """license, width, template (its shingles)."""
    rows = [(name, window_of(t), shingles(t)) for name, t in templates.items()]
    return spark.createDataFrame(rows, "license string, width int, template array<string>")


def template_bands(table: DataFrame) -> DataFrame:
    """license, width, bands (all of a template's), band, value: BANDS rows a template."""
    made = table.select("license", "width", _minhashes(F.transform(F.col("template"), lambda s: F.xxhash64(s))).alias("bands"))
    return made.select("license", "width", "bands", F.posexplode("bands").alias("band", "value"))


def _words_in(values: tuple[str, ...] | frozenset[str]) -> Column:
    return F.array(*map(F.lit, sorted(values)))


def _near_anchors(width: int, found: frozenset[str]) -> Column:
    """The starts of the windows with one of the anchors in them."""
    step, seeds = width // 4, _words_in(found)
    at = F.filter(F.sequence(F.lit(0), F.size("ws") - 1), lambda i: F.array_contains(seeds, F.get(F.col("ws"), i)))
    around = F.transform(at, lambda p: F.sequence(F.greatest(F.lit(0), F.ceil((p - (width - 1)) / step).cast("int")), F.floor(p / step).cast("int")))
    return F.transform(F.array_distinct(F.flatten(around)), lambda k: k * step)


def _with_width(width: int, starts: Column) -> Column:
    return F.transform(starts, lambda s: F.struct(F.lit(width).alias("width"), s.alias("start")))


def _has_long_words(ws: Column, templates: list[str]) -> Column:
    """Whether the words are enough for one of the templates, and as many of its longer words as it takes are among them."""
    enough = lambda t: F.size(ws) >= len(shingles(t)) - spare(t) + SHINGLE - 1
    return reduce(Column.__or__, [enough(t) & (F.size(F.array_intersect(ws, _words_in(long_words(t)[0]))) >= long_words(t)[1]) for t in templates])


def matches(docs: DataFrame, templates: dict[str, str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, license, containment, n_windows: the templates that windows of each text contain."""
    templates = checked(TEMPLATES if templates is None else templates)
    spark = docs.sparkSession
    table = template_table(spark, templates)
    anchored = [t for t in templates.values() if len(anchors(t)) <= MOST_ANCHORS]
    counted = [t for t in templates.values() if len(anchors(t)) > MOST_ANCHORS]
    has = lambda found: F.col(text).rlike(r"(?i)(?<![A-Za-z0-9])(?:" + "|".join(sorted(found)) + r")(?![A-Za-z0-9])")
    possible = has(frozenset().union(*map(anchors, anchored))) if anchored else F.lit(False)
    for t in counted:
        possible = possible | ((F.length(F.col(text)) >= least_chars(t)) & has(anchors(t)))
    rows = docs.select(F.col(key), F.col(text)).filter(possible).select(key, F.inline(F.array(F.struct(_word_array(F.col(text)).alias("ws"))))).filter(F.size("ws") >= SHINGLE)

    starts = []
    by_width = lambda of: {w: [t for t in of if window_of(t) == w] for w in sorted(set(map(window_of, of)))}
    for width, of in by_width(anchored).items():
        starts.append((width, _near_anchors(width, frozenset().union(*map(anchors, of)))))
    gates = {width: of for width, of in by_width(counted).items()}
    for width, of in gates.items():
        every = F.sequence(F.lit(0), F.size("ws") - 1, F.lit(width // 4))
        starts.append((width, F.when(_has_long_words(F.col("ws"), of), every).otherwise(F.array().cast("array<int>"))))
    if not starts:
        return docs.select(key, F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).cast("long").alias("n_windows")).limit(0)
    cut = F.array_distinct(F.concat(*[_with_width(width, s) for width, s in starts]))
    windows = rows.select(key, "ws", F.inline(cut)).select(key, "width", "start", F.inline(F.array(F.struct(F.slice(F.col("ws"), F.col("start") + 1, F.col("width")).alias("w")))))
    for width, of in by_width(list(templates.values())).items():
        windows = windows.filter((F.col("width") != width) | _has_long_words(F.col("w"), of))
    hashed = windows.select(key, "width", "start", F.inline(F.array(F.struct(_shingle_texts(F.col("w")).alias("found"))))).filter(F.size("found") > 0)
    banded = hashed.select(key, "width", "start", "found", F.inline(F.array(F.struct(_minhashes(F.transform(F.col("found"), lambda s: F.xxhash64(s))).alias("mins")))))
    each = banded.select(key, "width", "start", "found", "mins", F.posexplode("mins").alias("band", "value"))
    bands, held = template_bands(table), table.select("license", "template")
    bands = F.broadcast(bands) if len(templates) * BANDS <= BROADCAST_BANDS else bands
    held = F.broadcast(held) if sum(len(shingles(t)) for t in templates.values()) <= BROADCAST_SHINGLES else held
    # Of the bands in which a window and a template agree, the first has it verified.
    met = each.join(bands, ["width", "band", "value"]).filter(F.array_position(F.zip_with("mins", "bands", lambda x, y: x == y), True) == F.col("band") + 1)
    share = F.size(F.array_intersect("found", "template")) / F.size("template")
    verified = met.select(key, "license", "start", "found").join(held, "license").select(key, "license", "start", share.alias("containment")).filter(F.col("containment") >= THRESHOLD)
    once = verified.groupBy(key, "license", "start").agg(F.max("containment").alias("containment"))
    return once.groupBy(key, "license").agg(F.max("containment").alias("containment"), F.count("*").alias("n_windows"))


def op9(docs: DataFrame) -> DataFrame:
    return matches(docs)


def _sql_values() -> str:
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    return ",\n  ".join(f"({quoted(name)}, {window_of(t)}, {quoted(' '.join(words(t)))})" for name, t in TEMPLATES.items())


OP9_SQL = f"""
WITH tt(license, width, body) AS (VALUES
  {_sql_values()}),
ts AS (SELECT license, width, list_distinct(list_transform(range(1, len(b) - {SHINGLE - 2}), lambda i: array_to_string(b[i:i + {SHINGLE - 1}], ' '))) AS ss
  FROM (SELECT license, width, string_split(body, ' ') AS b FROM tt)),
t AS (SELECT license, width, len(ss) AS n, unnest(ss) AS shingle FROM ts),
d AS (
  SELECT doc_id, string_split(lower(trim(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g'))), ' ') AS ws FROM documents),
p AS (
  SELECT doc_id, i - 1 AS pos, array_to_string(ws[i:i + {SHINGLE - 1}], ' ') AS shingle
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {SHINGLE - 2})) AS i FROM d WHERE len(ws) >= {SHINGLE})),
h AS (SELECT doc_id, license, width, n, pos, shingle FROM p JOIN t USING (shingle)),
w AS (
  SELECT doc_id, license, n, shingle, unnest(range(
    greatest(0, CAST(ceil((pos + {SHINGLE} - width) / (width / 4.0)) AS BIGINT)), CAST(floor(pos / (width / 4.0)) AS BIGINT) + 1)) AS k
  FROM h),
c AS (SELECT doc_id, license, k, count(DISTINCT shingle) / max(n)::DOUBLE AS containment FROM w GROUP BY doc_id, license, k)
SELECT doc_id, license, max(containment) AS containment, count(*) AS n_windows FROM c WHERE containment >= {THRESHOLD} GROUP BY doc_id, license
"""
