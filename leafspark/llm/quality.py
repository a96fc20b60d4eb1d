"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled rows of quality 1; the unlabelled set is the texts of labelled rows, whose
own labels are left aside. The class prior is that set's: the share of quality 1 among the labelled
training rows. With it, a small network minimises the non-negative unbiased risk: prior times the risk of positives as positive, plus
the unlabelled risk as negative less prior times that of positives, which is held at zero or above by
stepping back whenever a fit takes it below. Negative labels enter by the prior alone.

Training uses a bounded sample of the labelled rows (``sample`` of each set, the least by a seeded hash of
the id) and no other row; scoring covers every row. Inputs are measures of the text and nothing else.

Defined results: a null text counts as empty and is scored; a null id is not held out; repeated rows
are scored alike; without positives or unlabelled rows every score is the prior (0.5 without labels);
an empty table gives no rows; other columns are ignored by ``quality_scores`` and passed on by
``keep_quality``.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from leafspark.llm.common import broadcast_up_to, short_batches, table

SAMPLE = 12_000
_SYMBOLS = re.compile(r"[^\w\s.,;:'\"()\-]")
_DIGITS = re.compile(r"\d")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")


def measures(text: str | None) -> list[float]:
    """Shape, repetition and character shares of one text."""
    text = text or ""
    n, words, lines = len(text), text.split(), text.split("\n")
    m = len(words)
    counts = Counter(words)
    size, one = max(n, 1), max(m, 1)
    raw = text.encode("utf-8", "surrogatepass")
    repeats = sum(map(str.__eq__, words, words[1:])) if m > 1 else 0
    edge = Counter(w[-1] for w in words)
    tails = sum(v for c, v in edge.items() if not c.isalnum())
    symbols = len(_SYMBOLS.findall(text))
    line_counts = Counter(lines)
    return [
        math.log1p(n),
        math.log1p(m),
        math.log1p(len(lines)),
        n / one / 10,
        len(counts) / one,
        max(counts.values(), default=0) / one,
        sum(v for v in counts.values() if v > 1) / one,
        repeats / one,
        math.log1p(100 * repeats / one),
        symbols / size,
        math.log1p(100 * symbols / size),
        symbols / one,
        text.count("|") / one,
        text.count("!") / one,
        text.count("?") / one,
        len(_DIGITS.findall(text)) / size,
        len(_UPPER.findall(text)) / size,
        sum(map(str.isupper, words)) / one,
        sum(map(str.islower, words)) / one,
        sum(map(str.istitle, words)) / one,
        text.count(".") / one,
        text.count(",") / one,
        text.count("\n") / one,
        tails / one,
        sum(1 for w in counts if not any(map(str.isalpha, w))) / max(len(counts), 1),
        1 - len(line_counts) / max(len(lines), 1),
        max(len(line) for line in lines) / size,
        len(zlib.compress(raw, 1)) / max(len(raw), 64),
    ]


def _softplus(x):
    return np.logaddexp(0.0, x)


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 16, steps: int = 600, seed: int = 7) -> dict:
    """A one-layer network of least non-negative unbiased logistic risk."""
    both = np.vstack([positive, unlabelled])
    mean, std = both.mean(0), both.std(0) + 1e-6
    x = np.clip((both - mean) / std, -6, 6)
    n_p, n_u = len(positive), len(unlabelled)
    rng = np.random.default_rng(seed)
    w = [rng.normal(0, 1 / math.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / math.sqrt(hidden), hidden), np.array(math.log(prior / (1 - prior)))]
    m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    for t in range(1, steps + 1):
        h = np.tanh(x @ w[0] + w[1])
        f = h @ w[2] + w[3]
        s = _sigmoid(f)
        rest = _softplus(f[n_p:]).mean() - prior * _softplus(f[:n_p]).mean()
        # Gradient by f of the negative part, and with it that of the positive part while the former is not below zero.
        g = np.concatenate([-prior * s[:n_p] / n_p, s[n_p:] / n_u])
        if rest < 0:
            g = -g
        else:
            g[:n_p] -= prior * (1 - s[:n_p]) / n_p
        back = np.outer(g, w[2]) * (1 - h * h)
        grads = [x.T @ back + 1e-4 * w[0], back.sum(0), h.T @ g + 1e-4 * w[2], g.sum()]
        rate = 0.02 * min(1.0, 2 * (1 - t / (steps + 1)))
        for i, d in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * d
            v[i] = 0.999 * v[i] + 0.001 * d * d
            w[i] = w[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return {"mean": mean, "std": std, "w": w, "prior": prior}


def apply_model(model: dict, rows: np.ndarray) -> np.ndarray:
    if "w" not in model:
        return np.full(len(rows), model["prior"])
    w = model["w"]
    h = np.tanh(np.clip((rows - model["mean"]) / model["std"], -6, 6) @ w[0] + w[1])
    return _sigmoid(h @ w[2] + w[3])


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> dict:
    """The model from at most ``sample`` positives and ``sample`` unlabelled rows, of the labelled ones that are not held out."""
    short_batches(docs.sparkSession)
    seen = labels.select(F.col("doc_id").alias("_id"), "quality").filter(
        F.col("quality").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id"))
    )
    order = F.xxhash64("_id", F.lit(7))
    prior = seen.agg(F.avg("quality")).first()[0]
    prior = min(max(prior, 0.02), 0.98) if prior is not None else 0.5
    trusted = seen.filter("quality = 1").select("_id").distinct().orderBy(order, "_id").limit(sample)
    others = seen.select("_id").distinct().orderBy(order, "_id").limit(sample)
    picked = trusted.withColumn("kind", F.lit(1)).union(others.withColumn("kind", F.lit(0))).filter("_id is not null")
    measure = F.pandas_udf(lambda s: pd.Series([measures(t) for t in s]), ArrayType(DoubleType()))
    rows = (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        .join(broadcast_up_to(picked, 2 * sample), "_id")
        .select("kind", measure("_text").alias("x"))
        .toPandas()
    )
    sets = [np.array(rows.x[rows.kind == k].tolist(), dtype=float) for k in (1, 0)]
    return fit(*sets, prior) if all(map(len, sets)) else {"prior": prior}


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted."""
    score = scorer(train(docs, labels, id_col, text_col, sample))
    return docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), score(F.col(text_col)).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


def scorer(model: dict):
    """The model as a function from a text column to a score column."""

    def run(s: pd.Series) -> pd.Series:
        return pd.Series(apply_model(model, np.array([measures(t) for t in s], dtype=float).reshape(len(s), -1)), dtype=float)

    return F.pandas_udf(run, DoubleType())


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` scored 0.5 or more, with all their columns."""
    score = scorer(train(docs, labels, id_col, text_col, sample))
    return docs.filter(score(F.col(text_col)) >= 0.5)


def op7_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op7_pu_quality": op7_pu_quality}
SQL: dict[str, str] = {}
