"""Queries of sources and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.events import windowed_counts
from ..session import table
from .registry import register


@register("windowed_events", "SELECT date_trunc('hour', ts) AS window_start, event_type AS kind, count(*) AS n, round(sum(value), 3) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def windowed_events(spark: SparkSession, d: str) -> DataFrame:
    return windowed_counts(table(spark, d, "events").where(F.col("ts").isNotNull()), "ts", "event_type")


@register("event_fold", "SELECT turn || ' ' || attempt AS key, CAST(max(event_no) AS INTEGER) AS last_event, arg_max(coalesce(response.status, item.status, '-'), event_no) AS status, CAST(count(DISTINCT event_no) AS INTEGER) AS seen FROM (SELECT DISTINCT ON (turn, attempt, event_no) * FROM p05_responses_multimessage) WHERE turn IS NOT NULL AND attempt IS NOT NULL AND event_no IS NOT NULL GROUP BY 1")
def event_fold(spark: SparkSession, d: str) -> DataFrame:
    """The state of every attempt after all its events, as the stream fold keeps it."""
    from ..streaming.folds import latest_states_batch

    e = table(spark, d, "p05_responses_multimessage").where("turn is not null and attempt is not null")
    status = F.coalesce("response.status", "item.status", F.lit("-"))
    return latest_states_batch(e.select(F.concat_ws(" ", "turn", "attempt").alias("key"), "event_no", status.alias("status")).dropDuplicates(["key", "event_no"]))
