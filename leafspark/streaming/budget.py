"""Token budgets over a stream: the fold of ``leafspark.operators.budget`` with its state kept by Spark."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leafspark.operators.budget import DAY, Limits, Spent, spend

COLUMNS = ["subject", "kind", "turn", "t", "known", "tokens"]


def stream_verdicts(events: DataFrame, limits: Limits, late: str = "10 minutes") -> DataFrame:
    """A stream of ``events(subject string, kind, turn long, t double, known, tokens double, at timestamp)`` to its
    verdicts. Rows later than ``late`` are dropped by the watermark on ``at``; a micro-batch's rows of a
    subject are taken in order of time, and earlier micro-batches stand. A subject's state goes a day after
    its last event, so state is of the subjects of a day."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        spent = Spent()
        if state.exists:
            *numbers, held = (None if x != x else x for x in state.get)
            spent = Spent(*numbers, {int(k): tuple(v) for k, v in json.loads(held).items()})
        rows = pd.concat(list(frames)).sort_values(["t", "kind", "turn"])
        out = []
        for r in rows.to_dict("records"):
            tokens = None if pd.isna(r["tokens"]) else r["tokens"]
            spent, made = spend(spent, limits, r["kind"], int(r["turn"]), r["t"], bool(r["known"]), tokens)
            out.append((key[0], r["kind"], int(r["turn"]), r["t"], *made))
        window = (float("nan") if x is None else x for x in (spent.minute, spent.day))
        state.update((next(window), spent.requests, next(window), spent.tokens, json.dumps(spent.open)))
        ends = int((rows["t"].max() + DAY) * 1000)
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        frame = pd.DataFrame(out, columns=["subject", "kind", "turn", "t", "verdict", "moved", "remaining"])
        yield frame.astype({"remaining": "Int64"})

    return (
        events.withWatermark("at", late)
        .groupBy("subject")
        .applyInPandasWithState(
            fold,
            "subject string, kind string, turn long, t double, verdict string, moved long, remaining long",
            "minute double, requests long, day double, tokens long, held string",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )
