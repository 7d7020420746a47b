"""What a model service's rate-limit errors say."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How a daily limit and the time to wait are told.
DAILY_MARKS = ("per day", "(TPD)", "(RPD)")
RETRY_IN = r"(?i)try again in ((?:[0-9]+h)?(?:[0-9]+m)?[0-9.]+s)"
DAILY_TEXT = "The model service allows no more calls today: its daily quota is used up."
MINUTE_TEXT = "The model service is asked too often at the moment and refuses calls for a while."


def is_daily_limit(message: str) -> bool:
    return any(mark.lower() in message.lower() for mark in DAILY_MARKS)


def rate_limit_message(message: Column) -> Column:
    daily = F.contains(message, F.lit(DAILY_MARKS[0])) | F.contains(message, F.lit(DAILY_MARKS[1])) | F.contains(message, F.lit(DAILY_MARKS[2]))
    wait = F.regexp_replace(F.regexp_extract(message, RETRY_IN, 1), "[.][0-9]+s", "s")
    when = F.when(wait != "", F.concat(F.lit(" Try again in about "), wait, F.lit("."))).otherwise("")
    return F.concat(F.when(daily, DAILY_TEXT).otherwise(MINUTE_TEXT), when)
