"""Mixing sources to target weights by hierarchical budgeting.

A domain - language - source tree gets a token budget at its root. Each node shares its budget among
its children by weight, none above what its subtree can supply over ``max_epochs`` epochs; what a
child can't use goes to its siblings first, and only what a whole subtree can't use goes back to its
ancestors. Water-filling gives this top-down in closed form: of the children in order of supply for
weight, the share for each unit of weight is the greatest of (budget - supplies before) / (weights
from here on). Each leaf then takes the prefix of its token stream: whole epochs, then the start of
one more, each epoch ordered by a seeded hash.

The running sum that finds a leaf's cut is two-level: token sums of 4096 hash ranges, then single
documents only inside the range of the cut, so no task holds a leaf.

Defined results: a null text has no tokens, a null domain, language or source is named ''; children of
weight zero or less get nothing; documents without tokens take part and take none; a leaf without
tokens selects nothing; repeated rows are separate documents; an empty table gives no rows; other
columns are ignored by ``selections`` and passed on by ``mix_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafspark.llm.common import broadcast_up_to, staged, table

LEAF = ["domain", "lang", "source"]
WORD = r"[^\x20\x09-\x0D]+"
#: The query's parameters: names that are missing weigh 1.
WEIGHTS = {
    "domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1},
    "lang": {"en": 5, "de": 2, "fr": 2, "es": 1},
    "source": {"src0": 3},
}
SHARE, EPOCHS, SEED = 0.6, 2, 11


def domain_of(source: Column) -> Column:
    """Four domains by the source's trailing number."""
    n = F.try_to_number(F.regexp_extract(source, r"(\d{1,9})$", 1), F.lit("999999999"))
    return F.concat(F.lit("d"), F.coalesce(n.cast("long") % 4, F.lit(0)).cast("string"))


def _weight(name: str, weights: dict) -> Column:
    case = F.lit(1)
    for value, weight in weights.get(name, {}).items():
        case = F.when(F.col(name) == value, F.lit(weight)).otherwise(case)
    return case.cast("double")


def _shared(nodes: DataFrame, parents: list[str], budget: str) -> DataFrame:
    """``nodes(…, cap, weight)`` with ``given``: each one's part of its parent's ``budget``."""
    # A constant stands for the root; the rows of a window are the children of one node.
    family = Window.partitionBy(*(parents or [F.lit(0)]))
    order = family.orderBy(F.col("cap") / F.col("weight"), *(c for c in LEAF if c in nodes.columns))
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    return (
        nodes.withColumn("unit", (F.col(budget) - before) / after)
        .withColumn("unit", F.max("unit").over(family))
        .withColumn("given", F.least("cap", F.col("weight") * F.col("unit")))
        .drop("unit")
    )


def allotments(leaves: DataFrame, weights: dict, share: float | None, tokens: int | None, max_epochs: int) -> DataFrame:
    """``leaves(domain, lang, source, supply)`` with ``allot``, the tokens each one gives. The budget is
    ``tokens``, or the given share of one epoch of everything; it never exceeds the supply."""
    leaves = leaves.withColumn("cap", (F.col("supply") * max_epochs).cast("double"))
    for c in LEAF:
        leaves = leaves.withColumn(f"w_{c}", _weight(c, weights))
    leaves = leaves.filter(" AND ".join(f"w_{c} > 0" for c in LEAF))
    budget = F.lit(float(tokens)) if tokens is not None else F.floor(F.lit(float(share)) * F.sum("supply"))
    total = leaves.agg(F.least(budget.cast("double"), F.sum("cap")).alias("budget"))
    domains = leaves.groupBy("domain").agg(F.sum("cap").alias("cap"), F.max("w_domain").alias("weight"))
    domains = _shared(domains.crossJoin(F.broadcast(total)), [], "budget").select("domain", F.col("given").alias("budget"))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"), F.max("w_lang").alias("weight"))
    langs = _shared(langs.join(domains, "domain"), ["domain"], "budget").select("domain", "lang", F.col("given").alias("budget"))
    nodes = leaves.withColumn("weight", F.col("w_source")).join(langs, ["domain", "lang"])
    return _shared(nodes, ["domain", "lang"], "budget").select(*LEAF, "supply", F.floor("given").cast("long").alias("allot"))


def selections(docs: DataFrame, weights: dict, share: float | None = None, tokens: int | None = None, max_epochs: int = 1, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a ``domain`` column to one row for each document and epoch taken: doc_id, the leaf,
    epoch, n_tokens, start in the leaf's epoch (null for whole epochs) and take_tokens."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    counted = staged(
        docs.select(F.col(id_col).alias("doc_id"), *map(name, LEAF), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens")),
        "tokens",
    )
    leaves = counted.groupBy(*LEAF).agg(F.sum("n_tokens").alias("supply"))
    plan = staged(
        allotments(leaves, weights, share, tokens, max_epochs).select(
            *LEAF,
            F.coalesce(F.floor(F.try_divide("allot", "supply")), F.lit(0)).cast("long").alias("whole"),
            F.coalesce(F.try_mod("allot", "supply"), F.lit(0)).alias("rest"),
        ),
        "allotments",
    )
    plan = broadcast_up_to(plan, 100_000)
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("whole"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = counted.join(plan, LEAF).withColumn("key", key).withColumn("range", F.substring("key", 1, 3))
    running = Window.partitionBy(*LEAF).orderBy("range")
    ranges = (
        rows.filter("rest > 0").groupBy(*LEAF, "range").agg(F.sum("n_tokens").alias("n"), F.max("rest").alias("rest"))
        .withColumn("before", F.sum("n").over(running) - F.col("n"))
        .filter("before < rest")
        .select(*LEAF, "range", "before", (F.col("before") + F.col("n") > F.col("rest")).alias("cut"))
    )
    inside = Window.partitionBy(*LEAF, "range").orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    part = (
        rows.filter("rest > 0").join(ranges, [*LEAF, "range"])
        .withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .filter("start < rest")
        .select("doc_id", *LEAF, F.col("whole").alias("epoch"), "n_tokens", "start", F.least("n_tokens", F.col("rest") - F.col("start")).alias("take_tokens"))
    )
    epochs = F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1))
    full = rows.filter("whole > 0").select(
        "doc_id", *LEAF, epochs.alias("epoch"), "n_tokens", F.lit(None).cast("long").alias("start"), F.col("n_tokens").alias("take_tokens")
    )
    return full.union(part)


def mix_documents(docs: DataFrame, weights: dict, share: float, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of one epoch that the mixture takes, with all their columns; one that the budget
    cuts stays whole."""
    taken = selections(docs.withColumn("domain", domain_of(F.col("source"))), weights, share=share, seed=seed, id_col=id_col, text_col=text_col)
    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"))
    taken = taken.select(F.col("doc_id").alias("taken")).distinct()
    return whole.join(taken, F.col("doc_id").eqNullSafe(F.col("taken")), "left_semi").select("row.*")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return selections(docs.withColumn("domain", domain_of(F.col("source"))), WEIGHTS, share=SHARE, max_epochs=EPOCHS)


def _sql_case(name: str) -> str:
    return "CASE " + name + " ".join(f" WHEN '{k}' THEN {v}" for k, v in WEIGHTS[name].items()) + " ELSE 1 END::DOUBLE"


def _sql_level(nodes: str, by: str, parents: str) -> str:
    over = f"PARTITION BY {parents}" if parents else ""
    keys = ", ".join(c for c in LEAF if c in by)
    return f"""(SELECT {by}, budget_in, least(cap, weight * max(unit) OVER ({over})) AS budget FROM (
  SELECT *, (budget_in - coalesce(sum(cap) OVER ({over} ORDER BY cap / weight, {keys} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER ({over} ORDER BY cap / weight, {keys} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit
  FROM ({nodes})))"""


SQL = {
    "op2_source_mixing": f"""
WITH t AS (
  SELECT doc_id, 'd' || (coalesce(try_cast(regexp_extract(source, '(\\d{{1,9}})$', 1) AS BIGINT), 0) % 4) AS domain,
         coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens
  FROM documents),
leaves AS (
  SELECT domain, lang, source, sum(n_tokens)::BIGINT AS supply, sum(n_tokens)::DOUBLE * {EPOCHS} AS cap FROM t GROUP BY ALL),
total AS (SELECT least(floor({SHARE}::DOUBLE * sum(supply)), sum(cap)) AS budget_in FROM leaves),
domains AS (SELECT * FROM {_sql_level("SELECT domain, sum(cap) AS cap, any_value(" + _sql_case("domain") + ") AS weight, any_value(budget_in) AS budget_in FROM leaves, total GROUP BY domain", "domain", "")}),
langs AS (SELECT * FROM {_sql_level("SELECT l.domain, l.lang, sum(l.cap) AS cap, any_value(" + _sql_case("lang") + ") AS weight, any_value(d.budget) AS budget_in FROM leaves l JOIN domains d USING (domain) GROUP BY l.domain, l.lang", "domain, lang", "domain")}),
plan AS (
  SELECT p.domain, p.lang, p.source, l.supply, floor(p.budget)::BIGINT AS allot
  FROM {_sql_level("SELECT l.domain, l.lang, l.source, l.cap, " + _sql_case("source") + " AS weight, g.budget AS budget_in FROM leaves l JOIN langs g USING (domain, lang)", "domain, lang, source", "domain, lang")} p
  JOIN leaves l USING (domain, lang, source)),
r AS (
  SELECT t.*, coalesce(allot // nullif(supply, 0), 0) AS whole, coalesce(allot % nullif(supply, 0), 0) AS rest
  FROM t JOIN plan USING (domain, lang, source)),
part AS (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source
      ORDER BY md5('{SEED}:' || whole || ':' || coalesce(doc_id::VARCHAR, '')), doc_id, n_tokens
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM r WHERE rest > 0)
SELECT doc_id, domain, lang, source, epoch, n_tokens, NULL::BIGINT AS start, n_tokens AS take_tokens
FROM (SELECT *, unnest(range(whole)) AS epoch FROM r WHERE whole > 0)
UNION ALL
SELECT doc_id, domain, lang, source, whole, n_tokens, start, least(n_tokens, rest - start) FROM part WHERE start < rest
"""
}
QUERIES = {"op2_source_mixing": op2_source_mixing}
