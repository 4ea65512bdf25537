"""Event folds over streams: the state of a key is kept between batches and events are folded in their own order.

Events of a key may arrive late or twice; the fold keeps the greatest event number it has seen and the
number of distinct ones, so that a re-delivered batch changes nothing and the result is that of a batch
over all events.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, last_event int, status string, seen int"
STATE = "last_event int, status string, events array<int>"


def latest_states_batch(events: DataFrame) -> DataFrame:
    """(key, last_event, status, seen) of events (key, event_no, status): the status of the greatest event number and how many numbers were seen."""
    return events.where("key is not null and event_no is not null").groupBy("key").agg(F.max("event_no").cast("int").alias("last_event"), F.max_by("status", "event_no").alias("status"), F.countDistinct("event_no").cast("int").alias("seen"))


def _fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, status, events = state.get if state.exists else (-1, None, [])
    known = set(events)
    for part in parts:
        for number, word in zip(part["event_no"], part["status"]):
            known.add(int(number))
            if number > last:
                last, status = int(number), word
    state.update((last, status, sorted(known)))
    yield pd.DataFrame({"key": [key[0]], "last_event": [last], "status": [status], "seen": [len(known)]})


def latest_states(stream: DataFrame) -> DataFrame:
    """``latest_states_batch`` of a stream, in update mode: a key's row is sent anew whenever its events arrive."""
    rows = stream.where("key is not null and event_no is not null").select(F.col("key").cast("string"), F.col("event_no").cast("int"), "status")
    return rows.groupBy("key").applyInPandasWithState(_fold, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
