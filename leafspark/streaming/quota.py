"""The quota as a stream: one state for each subject, the same verdicts as the batch form.

An extension in one respect: within a micro-batch a subject's events are taken in order of time, across
batches in order of arrival.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leafspark.operators.quota import judge

OUT = "subject long, event_id long, verdict string, used double"
STATE = "m0 double, mn long, d0 double, dn long, b0 double, bytes double"


def verdict_stream(events: DataFrame, per_minute: int, per_day: int, bytes_per_day: float) -> DataFrame:
    """A stream of (subject, event_id, t, bytes) to verdicts, in append mode."""
    limits = per_minute, per_day, bytes_per_day

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [None if x != x else x for x in state.get] if state.exists else [None, 0, None, 0, None, 0.0]
        rows = pd.concat(list(frames)).sort_values(["t", "event_id"])
        out = [(key[0], int(r.event_id), *judge(held, r.t, r.bytes, limits)) for r in rows.itertuples()]
        state.update(tuple(float("nan") if x is None else x for x in held))
        yield pd.DataFrame(out, columns=["subject", "event_id", "verdict", "used"])

    return events.groupBy("subject").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
