"""Lines of plain texts, and running page footers. The texts are split within their rows: no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.constants import FOOTER_MIN_REPEATS
from lodestrata.functions.text import clean_line, footer_label, is_noise, raw_lines


def text_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_no, text: the lines of each text, cleaned, without blank lines and noise. Null texts have none."""
    numbered = docs.select(key, F.posexplode(raw_lines(F.col(text))).alias("line_no", "raw"))
    return numbered.select(key, "line_no", clean_line(F.col("raw")).alias("text")).filter(~is_noise(F.col("text")))


def footer_labels(lines: DataFrame, key: str = "doc_id", most: int = FOOTER_MIN_REPEATS) -> DataFrame:
    """key, label, n: footer labels that a document repeats `most` times or more."""
    labelled = lines.select(key, footer_label(F.col("text")).alias("label")).filter(F.col("label").isNotNull())
    return labelled.groupBy(key, "label").agg(F.count("*").alias("n")).filter(F.col("n") >= most)


def strip_page_footers(lines: DataFrame, key: str = "doc_id", most: int = FOOTER_MIN_REPEATS) -> DataFrame:
    """The lines but for those of a repeated footer label. Labels are few beside lines, so the anti join's
    side of labels is small, and adaptive execution broadcasts it if it is."""
    labelled = lines.withColumn("_label", footer_label(F.col("text")))
    repeated = footer_labels(lines, key, most).select(F.col(key), F.col("label").alias("_label"))
    return labelled.join(repeated, [key, "_label"], "left_anti").select(*lines.columns)


def first_occurrences(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each distinct line of a document once, where it comes first."""
    own = Window.partitionBy(key, "text").orderBy("line_no")
    return lines.withColumn("_n", F.row_number().over(own)).filter("_n = 1").drop("_n")
