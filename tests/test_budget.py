"""Token budgets: the batch fold against counters with expiry, and the stream against the batch."""

import random

from pyspark.sql import functions as F

from leafspark.operators.budget import Limits, budget_verdicts
from leafspark.streaming.budget import COLUMNS, stream_verdicts

LIMITS = Limits(per_minute=3, daily=500, anonymous=200, reserve=20)
SCHEMA = "subject string, kind string, turn long, t double, known boolean, tokens double"


def brute(rows):
    """Counters by name that vanish when their time is over."""
    counters, held, out = {}, {}, set()

    def count(name, t, by, seconds):
        ends, value = counters.get(name, (None, 0))
        if ends is None or t >= ends:
            ends, value = t + seconds, 0
        counters[name] = (ends, value + by)
        return value + by

    for subject, kind, turn, t, known, tokens in sorted(rows, key=lambda r: (r[3], r[1], r[2])):
        limit = LIMITS.daily if known else LIMITS.anonymous
        if kind == "settle":
            reserved = held.pop((subject, turn), None)
            if reserved is None or tokens is None:
                verdict = ("ignored", 0, None)
            else:
                moved = int(tokens) - reserved
                used = count(("tokens", subject), t, moved, 86400) if moved else counters[("tokens", subject)][1]
                verdict = ("settled", moved, max(0, limit - used))
        elif count(("requests", subject), t, 1, 60) > LIMITS.per_minute:
            verdict = ("minute", 0, None)
        else:
            reserved = LIMITS.reserve + max(0, int(tokens or 0))
            used = count(("tokens", subject), t, reserved, 86400)
            if used > limit:
                used = count(("tokens", subject), t, -reserved, 86400)
                verdict = ("day", 0, max(0, limit - used))
            else:
                held[subject, turn] = reserved
                verdict = ("ok", reserved, max(0, limit - used))
        out.add((subject, kind, turn, *verdict))
    return out


def made(seed, subjects=6, n=400):
    rng, rows, t = random.Random(seed), [], 0.0
    for turn in range(n):
        t += rng.choice([0.5, 7.0, 25.0, 900.0, 9000.0])
        subject, known, tokens = f"s{rng.randrange(subjects) if rng.random() < 0.5 else 0}", rng.random() < 0.6, rng.choice([None, -3.0, 0.0, 11.5, 90.0, 600.0])
        rows.append((subject, "reserve", turn, t, known, tokens))
        if rng.random() < 0.7:
            rows.append((subject, "settle", turn, t + 0.25, known, rng.choice([None, 0.0, 35.0, 120.0])))
    return rows


def test_batch_same_as_brute_force(spark):
    rows = made(1)
    odd = [("x", "settle", 9, 5.0, True, 3.0), ("x", "reserve", None, 1.0, True, 1.0), ("x", "reserve", 1, None, True, 1.0)]
    got = budget_verdicts(spark.createDataFrame(rows + odd, SCHEMA).repartition(3), LIMITS)
    found = {(r["subject"], r["kind"], r["turn"], r["verdict"], r["moved"], r["remaining"]) for r in got.collect()}
    assert found == brute(rows) | {("x", "settle", 9, "ignored", 0, None)}
    assert {v[3] for v in found} == {"ok", "minute", "day", "settled", "ignored"}
    assert budget_verdicts(spark.createDataFrame([], SCHEMA), LIMITS).collect() == []


def test_stream_over_several_batches_agrees_and_drops_late_rows(spark, tmp_path):
    rows = made(2, n=150)
    parts = [rows[: len(rows) // 3], rows[len(rows) // 3 : 2 * len(rows) // 3], rows[2 * len(rows) // 3 :]]
    late = ("s0", "reserve", 10**6, rows[0][3], True, 1.0)
    source, out = tmp_path / "in", tmp_path / "out"
    for i, part in enumerate([*parts, [late]]):
        frame = spark.createDataFrame(part, SCHEMA).withColumn("at", F.timestamp_seconds("t")).coalesce(1)
        frame.write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(SCHEMA + ", at timestamp").parquet(str(source))
        query = stream_verdicts(stream.select(*COLUMNS, "at"), LIMITS).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).outputMode("append").trigger(availableNow=True).start(str(out))
        query.awaitTermination()
    got = {(r["subject"], r["kind"], r["turn"], r["verdict"], r["moved"], r["remaining"]) for r in spark.read.parquet(str(out)).collect()}
    assert got == brute(rows) and i == 3
