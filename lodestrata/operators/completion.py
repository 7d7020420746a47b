"""Calls to a language model, behind an interface, with waits at rate limits."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from lodestrata.constants import DEFAULT_TEMPERATURE, DEFAULT_WAIT_SECONDS, MAX_WAIT_SECONDS, RATE_LIMIT_RETRIES
from lodestrata.functions.limits import is_daily_limit


class RateLimited(Exception):
    """A service's refusal; retry_after: the seconds it asks for, as text, if it does."""

    def __init__(self, message: str, retry_after: str | None = None):
        super().__init__(message)
        self.retry_after = retry_after


class DailyQuotaExhausted(Exception):
    """No call succeeds before the next day."""


class Client(Protocol):
    def complete(self, prompt: str, max_tokens: int | None, temperature: float) -> str | None: ...


def wait_seconds(error: RateLimited) -> float:
    try:
        return min(MAX_WAIT_SECONDS, float(error.retry_after))
    except (TypeError, ValueError):
        return DEFAULT_WAIT_SECONDS


def with_rate_limit_retries(call: Callable[[], str | None], sleep: Callable[[float], None] = time.sleep) -> str | None:
    """call(), again after the asked wait where a per-minute limit is hit; a daily limit ends it at once."""
    for _ in range(RATE_LIMIT_RETRIES):
        try:
            return call()
        except RateLimited as error:
            if is_daily_limit(str(error)):
                raise DailyQuotaExhausted(str(error)) from error
            sleep(wait_seconds(error))
    return call()


def complete(rows: DataFrame, make: Callable[[], Client], max_tokens: int | None, temperature: float = DEFAULT_TEMPERATURE, prompt: str = "prompt", calls_at_once: int = 1) -> DataFrame:
    """rows with `reply` (empty if the model gives none) and `stopped`: why no call was made, once the daily
    quota is used up. Null prompts make no call and get a null reply. One client a partition."""
    schema = T.StructType([*rows.schema.fields, T.StructField("reply", T.StringType()), T.StructField("stopped", T.StringType())])

    at = rows.columns.index(prompt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, stopped = None, None
        for batch in batches:
            replies, reasons = [], []
            for text in batch.column(at).to_pylist():
                reply = None
                if text is not None and stopped is None:
                    client = client or make()
                    try:
                        reply = with_rate_limit_retries(lambda text=text: client.complete(text, max_tokens, temperature)) or ""
                    except DailyQuotaExhausted as error:
                        stopped = f"daily quota exhausted: {error}"
                replies.append(reply)
                reasons.append(stopped if reply is None and text is not None else None)
            made = [pa.array(replies, pa.string()), pa.array(reasons, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "reply", "stopped"])

    return rows.repartition(calls_at_once).mapInArrow(run, schema)


def complete_kept(rows: DataFrame, key: str, path: str, make: Callable[[], Client], max_tokens: int | None, temperature: float = DEFAULT_TEMPERATURE, prompt: str = "prompt", steps: int = 16, calls_at_once: int = 1) -> DataFrame:
    """complete() in steps, whose replies are kept at path (shared by all executors): what a lost executor, a used-up quota or a
    new start asks again is one step's prompts at most, never those already answered.

    A step is a part of the keys by their hash. The keys of a step that have a reply are left out of it; once a step ends with
    the quota used up, no further one is begun. Rows come back with reply and stopped as of complete(); stopped is "not asked" for
    the rows of steps that weren't begun."""
    spark, step_of = rows.sparkSession, F.pmod(F.xxhash64(key), F.lit(steps)).cast("int")
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, reply string"

    def kept() -> DataFrame:
        try:
            return spark.read.schema(f"{schema}, step int").parquet(path)
        except AnalysisException:
            return spark.createDataFrame([], f"{schema}, step int")

    asked, stopped = rows.select(key, prompt).filter(F.col(prompt).isNotNull()), None
    for step in range(steps):
        left = asked.filter(step_of == step).join(kept().select(key), key, "left_anti")
        if stopped is not None or left.isEmpty():
            continue
        made = complete(left, make, max_tokens, temperature, prompt, calls_at_once)
        # The replies are written as they come; the reason to stop is told by the rows that have none.
        made.withColumn("step", F.lit(step)).select(key, "reply", "stopped", "step").write.mode("append").parquet(f"{path}/_tried")
        tried = spark.read.parquet(f"{path}/_tried").filter(F.col("step") == step)
        answered = tried.filter("reply IS NOT NULL").select(key, "reply").dropDuplicates([key])
        answered.withColumn("step", F.lit(step)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("step").parquet(path)
        stopped = tried.join(answered.select(key), key, "left_anti").agg(F.max("stopped")).first()[0]
    why = F.when(F.col(prompt).isNotNull() & F.col("reply").isNull(), F.lit(stopped or "not asked"))
    return rows.join(kept().select(key, "reply"), key, "left").withColumn("stopped", why)
