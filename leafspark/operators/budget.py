"""Token budgets: a turn reserves its worst case and settles to what it used.

A request counts by minute; then its reservation counts against the day's allowance and is given back when
it would exceed it. Windows begin with the first count and last a fixed time. A settlement moves the day's
count by what was used less what was reserved; one whose use isn't known keeps the reservation, and one
without an allowed reservation changes nothing. What an event finds depends on all earlier ones of its
subject: an ordered fold, which the batch form runs over sorted rows and ``leafspark.streaming.budget``
over a stream. The state is four numbers and the reservations not yet settled, a day's at most.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafspark.operators.folds import folded

MINUTE, DAY = 60.0, 86400.0


@dataclass(frozen=True)
class Limits:
    per_minute: int
    daily: int
    anonymous: int
    reserve: int


@dataclass
class Spent:
    minute: float | None = None
    requests: int = 0
    day: float | None = None
    tokens: int = 0
    open: dict[int, tuple[float, int]] = field(default_factory=dict)

    def add(self, t: float, tokens: int) -> int:
        if self.day is None or t >= self.day + DAY:
            self.day, self.tokens = t, 0
        self.tokens += tokens
        return self.tokens


def spend(state: Spent | None, limits: Limits, kind: str, turn: int, t: float, known: bool, tokens: float | None):
    """One event's verdict: ok, minute, day, settled or ignored; tokens reserved or moved, and the rest of the day."""
    state = state or Spent()
    limit = limits.daily if known else limits.anonymous
    if kind == "settle":
        held = state.open.pop(turn, None)
        if held is None or tokens is None:
            return state, ("ignored", 0, None)
        moved = int(tokens) - held[1]
        return state, ("settled", moved, max(0, limit - (state.add(t, moved) if moved else state.tokens)))
    if state.minute is None or t >= state.minute + MINUTE:
        state.minute, state.requests = t, 0
    state.requests += 1
    if state.requests > limits.per_minute:
        return state, ("minute", 0, None)
    reserved = limits.reserve + max(0, int(tokens or 0))
    used = state.add(t, reserved)
    if used > limit:
        state.tokens -= reserved
        return state, ("day", 0, max(0, limit - state.tokens))
    state.open = {k: v for k, v in state.open.items() if v[0] > t - DAY}
    state.open[turn] = (t, reserved)
    return state, ("ok", reserved, max(0, limit - used))


def budget_verdicts(events: DataFrame, limits: Limits) -> DataFrame:
    """``events(subject, kind 'reserve' or 'settle', turn, t seconds, known, tokens)`` with verdict, moved and
    remaining. Rows without a time or subject's turn are left out; of one time, reservations come first."""
    rows = events.filter("t IS NOT NULL AND turn IS NOT NULL").select("subject", "kind", "turn", "t", F.coalesce("known", F.lit(False)).alias("known"), "tokens")
    return folded(rows, ["subject"], ["t", "kind", "turn"], ["kind", "turn", "t", "known", "tokens"], "verdict string, moved long, remaining long", lambda state, *event: spend(state, limits, *event))
