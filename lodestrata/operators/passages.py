"""Which texts hold which passages, found by an equi-join on a word of the passage.

A passage's inner words stand whole in every text that holds it, parted by spaces as there. Of these words, the one that
stands in the fewest texts (of the passage's scope, if passages have one) finds the texts to look at; only those are searched.
Passages of less than three words have no inner word and are looked for in every text of their scope: without a scope
that is a nested loop over those few. Empty passages are in no text.

Where texts are lines and passages are as many, one word finds a share of all lines for each passage. Lines are then not held
against passages: the parts that are cut as some passage with that word is (its shape) are taken from the line, and a second
equi-join tells which of them are passages. Rows grow with the lines' words and the shapes of one word, not with pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _inner(passage: Column) -> Column:
    words = F.split(passage, " ")
    return F.array_distinct(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))))


def _rarest(words: DataFrame, common: DataFrame, key: list[str], scope: list[str]) -> DataFrame:
    """The row of each key of words (key, _word) whose word is in the fewest texts by common (scope, _word, _n)."""
    rarest = Window.partitionBy(*key).orderBy("_n", "_word")
    # A word of the passage that no text has rules the passage out, so that the join with the counts loses nothing.
    return words.join(common, [*scope, "_word"], "left").withColumn("_at", F.row_number().over(rarest)).filter("_at = 1 AND _n IS NOT NULL").drop("_at", "_n")


def holding(texts: DataFrame, passages: DataFrame, text_key: str, passage_key: str, scope: list[str] | None = None) -> DataFrame:
    """scope, text_key, passage_key: the texts (scope, text_key, _t) that hold a passage (scope, passage_key, _p)."""
    scope = scope or []
    wanted = passages.select(*scope, passage_key, "_p").filter(F.col("_p") != "")
    anchors = wanted.withColumn("_inner", _inner(F.col("_p")))
    each = texts.select(*scope, text_key, F.explode(F.array_distinct(F.split("_t", " "))).alias("_word"))
    words = anchors.select(*scope, passage_key, F.explode("_inner").alias("_word"))
    common = each.join(words.select(*scope, "_word").distinct(), [*scope, "_word"]).groupBy(*scope, "_word").agg(F.count("*").alias("_n"))
    chosen = _rarest(words, common, [*scope, passage_key], scope).join(wanted, [*scope, passage_key])
    near = each.join(chosen, [*scope, "_word"]).select(*scope, text_key, passage_key, "_p").join(texts.select(*scope, text_key, "_t"), [*scope, text_key])
    found = near.filter(F.contains("_t", F.col("_p"))).select(*scope, text_key, passage_key)
    short = anchors.filter(F.size("_inner") == 0).select(*scope, passage_key, "_p")
    bodies = texts.select(*scope, text_key, "_t")
    everywhere = bodies.join(short, scope) if scope else bodies.crossJoin(short)
    return found.union(everywhere.filter(F.contains("_t", F.col("_p"))).select(*scope, text_key, passage_key)).distinct()


def _shape(passage: Column, word: Column | None = None) -> Column:
    """How a passage is cut from words: how many it touches (n), which of them is word (k; from 0), and how many characters it has
    of the first (a) and of the last (b)."""
    words = F.split(passage, " ")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    k = F.lit(0) if word is None else F.array_position(inner, word).cast("int")
    return F.struct(F.size(words).alias("n"), k.alias("k"), F.length(F.get(words, F.lit(0))).alias("a"), F.length(F.get(words, F.size(words) - 1)).alias("b"))


def _parts(words: Column, shapes: Column, word: Column | None = None) -> Column:
    """What is cut from words by the shapes about each place where word stands (None: about every place), each part once."""

    def cut(i: Column, s: Column) -> Column:
        first, last = F.get(words, i - s["k"]), F.get(words, i - s["k"] + s["n"] - 1)
        inner = F.slice(words, i - s["k"] + 2, s["n"] - 2)
        part = F.array_join(F.concat(F.array(F.right(first, s["a"])), inner, F.array(F.left(last, s["b"]))), " ")
        return F.when((F.length(first) >= s["a"]) & (F.length(last) >= s["b"]), part)

    places = F.transform(words, lambda w, i: i if word is None else F.when(w == word, i))
    return F.array_distinct(F.array_compact(F.flatten(F.transform(F.array_compact(places), lambda i: F.transform(shapes, lambda s: cut(i, s))))))


def _pieces(words: Column, lengths: Column) -> Column:
    """What lies within a word and has one of the lengths, each piece once."""
    within = lambda w, n: F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda c: F.substring(w, c, n))
    return F.array_distinct(F.flatten(F.flatten(F.transform(words, lambda w: F.transform(F.filter(lengths, lambda n: n <= F.length(w)), lambda n: within(w, n))))))


def lines_holding(lines: DataFrame, passages: DataFrame, scope: list[str]) -> DataFrame:
    """lines (scope, _t and whatever else) with the passages (scope, _p and whatever else; each _p of a scope once) that they hold,
    some of them twice. Nothing here is bounded, so that no join is left to be broadcast for the size of the files alone."""
    wanted = passages.select(*scope, "_p").filter(F.col("_p") != "").withColumn("_inner", _inner(F.col("_p")))
    each = lines.withColumn("_word", F.explode(F.array_distinct(F.split("_t", " "))))
    common = each.groupBy(*scope, "_word").agg(F.count("*").alias("_n")).hint("shuffle_hash")
    chosen = _rarest(wanted.select(*scope, "_p", F.explode("_inner").alias("_word")), common, [*scope, "_p"], scope)
    shapes = chosen.groupBy(*scope, "_word").agg(F.collect_set(_shape(F.col("_p"), F.col("_word"))).alias("_shapes"))
    near = each.join(shapes.hint("shuffle_hash"), [*scope, "_word"]).withColumn("_words", F.split("_t", " "))
    about = near.select(*lines.columns, F.explode(_parts(F.col("_words"), F.col("_shapes"), F.col("_word"))).alias("_p"))
    short, two = wanted.filter(F.size("_inner") == 0), F.size(F.split("_p", " ")) == 2
    cuts = short.groupBy(*scope).agg(F.collect_set(F.when(two, _shape(F.col("_p")))).alias("_shapes"), F.collect_set(F.when(~two, F.length("_p"))).alias("_lengths"))
    both = F.concat(_parts(F.col("_words"), F.col("_shapes")), _pieces(F.col("_words"), F.col("_lengths")))
    anywhere = lines.join(cuts.hint("shuffle_hash"), scope).withColumn("_words", F.split("_t", " ")).select(*lines.columns, F.explode(both).alias("_p"))
    return about.union(anywhere).join(passages.hint("merge"), [*scope, "_p"])
