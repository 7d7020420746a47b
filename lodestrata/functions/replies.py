"""Model replies: score and reason."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.constants import INSUFFICIENT_LINE, INSUFFICIENT_PREFIX, MAX_SCORE, MIN_SCORE, NO_REASON, REASON_LINE, SCORE_LINE, UNPARSED_REPLY
from lodestrata.functions.text import stripped

_FLAGS = "(?imUd)"


def parse_reply(raw: Column) -> Column:
    """struct<score int, reason string> of a reply; score is null if the model says INSUFFICIENT, or if there
    is no whole number from 1 to 10. Asterisks (bold type) are ignored; a null reply counts as empty."""
    text = F.replace(F.coalesce(raw, F.lit("")), F.lit("*"), F.lit(""))
    found = stripped(F.regexp_extract(text, _FLAGS + REASON_LINE, 1))
    reason = F.when(text.rlike(_FLAGS + REASON_LINE), found).otherwise(F.lit(NO_REASON))
    number = F.nullif(F.regexp_extract(text, _FLAGS + SCORE_LINE, 1), F.lit("")).try_cast("int")
    insufficient = text.rlike(_FLAGS + INSUFFICIENT_LINE)
    valid = ~insufficient & F.coalesce(number.between(MIN_SCORE, MAX_SCORE), F.lit(False))
    said = F.when(insufficient, F.concat(F.lit(INSUFFICIENT_PREFIX), reason)).when(valid, reason).otherwise(F.lit(UNPARSED_REPLY))
    return F.struct(F.when(valid, number).alias("score"), said.alias("reason"))
