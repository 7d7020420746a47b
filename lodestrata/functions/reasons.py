"""The short form of a score's reason."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.constants import EMPTY_PARENTHESES, FLAGS, FLAGS_ANY_CASE, SCALE_FIGURE, SCALE_FILLER, SCALE_TERMS, SCALE_WORD, SENTENCE_END, SHORT_REASON_WORDS
from lodestrata.functions.citations import without_citations
from lodestrata.functions.text import clean_line, let


def restates_scale(sentence: Column) -> Column:
    """Names figures of scale, and apart from those only filler and capitalised words."""
    rest = F.regexp_replace(F.regexp_replace(sentence, FLAGS_ANY_CASE + SCALE_TERMS, " "), FLAGS + SCALE_FIGURE, " ")
    filler = F.array(*map(F.lit, SCALE_FILLER))
    known = F.forall(F.regexp_extract_all(rest, F.lit(FLAGS + SCALE_WORD), F.lit(0)), lambda w: F.array_contains(filler, F.lower(w)) | w.rlike(r"^\p{Lu}"))
    return sentence.rlike(FLAGS_ANY_CASE + SCALE_TERMS) & known


def sentences(text: Column) -> Column:
    """The sentences of a text without their end marks; a period ends one only after a small letter, a digit,
    a percent sign, a bracket or another period."""

    def stripped_of_marks(parts: Column) -> Column:
        last = F.rtrim(clean_line(F.element_at(parts, -1)), F.lit("."))
        return F.filter(F.concat(F.transform(F.slice(parts, 1, F.size(parts) - 1), clean_line), F.array(last)), lambda s: s != "")

    return let(F.split(text, FLAGS + SENTENCE_END, -1), stripped_of_marks)


def short_reason(reason: Column, max_words: int = SHORT_REASON_WORDS) -> Column:
    """The first sentence that does more than restate the scale (else the first), capitalised, without
    citations, of max_words words at most."""
    bare = clean_line(F.regexp_replace(without_citations(reason), FLAGS_ANY_CASE + EMPTY_PARENTHESES, ""))

    def first_telling(parts: Column) -> Column:
        telling = F.filter(parts, lambda s: ~restates_scale(s))
        return let(F.coalesce(F.get(telling, F.lit(0)), F.get(parts, F.lit(0)), F.lit("")), cut)

    def cut(line: Column) -> Column:
        words = F.split(F.concat(F.upper(F.substring(line, 1, 1)), F.substring(line, 2, 1 << 30)), " ")
        return let(words, lambda w: F.concat(F.array_join(F.slice(w, 1, max_words), " "), F.when(F.size(w) > max_words, "…").otherwise("")))

    return let(sentences(F.regexp_replace(bare, FLAGS + r"\s+([.,;:)])", "$1")), first_telling)
