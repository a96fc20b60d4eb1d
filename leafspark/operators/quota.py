"""Quotas by windows that begin with a subject's first event and last a fixed time.

An event counts by minute, then by day, then by bytes; a refused event still counts in the windows it
reached, but its bytes are given back. An event at the very end of a window begins a new one. What an
event finds depends on all earlier ones of its subject, so a subject is an ordered fold; the batch form
streams sorted rows through it and the stream form (``leafspark.streaming.quota``) keeps the same state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MINUTE, DAY = 60.0, 86400.0


def judge(state: list, t: float | None, amount: float | None, limits: tuple[int, int, float]) -> tuple[str, float | None]:
    """Updates a subject's windows by one event."""
    if state[0] is None or t >= state[0] + MINUTE:
        state[0], state[1] = t, 0
    state[1] += 1
    if state[1] > limits[0]:
        return "minute", float(state[1])
    if state[2] is None or t >= state[2] + DAY:
        state[2], state[3] = t, 0
    state[3] += 1
    if state[3] > limits[1]:
        return "day", float(state[3])
    if state[4] is None or t >= state[4] + DAY:
        state[4], state[5] = t, 0.0
    if amount is None:
        return "ok", None
    used = state[5] + amount
    if used > limits[2]:
        return "bytes", used
    state[5] = used
    return "ok", used


def verdicts(events: DataFrame, per_minute: int, per_day: int, bytes_per_day: float) -> DataFrame:
    """``events(subject, event_id, t seconds, bytes)`` to subject, event_id, verdict, used. A subject's
    events pass one task in order, sorted outside memory; only its six numbers of state are held."""
    limits = per_minute, per_day, bytes_per_day
    subject = events.schema["subject"].dataType
    out = StructType().add("subject", subject).add("event_id", "long").add("verdict", "string").add("used", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), []
        for batch in batches:
            subjects, found = batch.column(0), []
            for own, t, amount in zip(subjects.to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if own != now:
                    now, state = own, [None, 0, None, 0, None, 0.0]
                found.append(judge(state, t, amount, limits))
            verdict, used = pa.array([v for v, _ in found], pa.string()), pa.array([u for _, u in found], pa.float64())
            yield pa.RecordBatch.from_arrays([subjects, batch.column(1), verdict, used], ["subject", "event_id", "verdict", "used"])

    rows = events.select("subject", F.col("event_id").cast("long"), F.col("t").cast("double"), F.col("bytes").cast("double"))
    return rows.repartition("subject").sortWithinPartitions("subject", "t", "event_id", "bytes").mapInArrow(run, out)


def settled(reserved: DataFrame) -> DataFrame:
    """``reserved(subject, reserved, actual)`` to what each subject is charged in the end."""
    return reserved.groupBy("subject").agg(F.sum("reserved").alias("reserved"), F.sum(F.col("actual") - F.col("reserved")).alias("delta"), F.sum("actual").alias("charged"))
