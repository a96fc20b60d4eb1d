"""Recipes: named steps over tables, checked and then run as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_STEPS = 20
#: Tools whose output is pages again, so that a later step can take it.
CHAINABLE = ("merge", "organize", "rotate", "flatten", "stamp", "bates-numbering", "resize", "compress", "watermark")
TOOLS = (*CHAINABLE, "inspect", "pdf-to-text", "split-by-pages", "zip")


def recipe_errors(steps: DataFrame) -> DataFrame:
    """``steps(recipe_id, pos, step_id, tool, input_kind, input_ref)`` to what is wrong with them."""
    known = F.col("tool").isin(*TOOLS)
    again = F.row_number().over(Window.partitionBy("recipe_id", "step_id").orderBy("pos")) > 1
    size = F.count(F.lit(1)).over(Window.partitionBy("recipe_id"))
    own = steps.withColumn("errors", F.array_compact(F.array(
        F.when(~known, F.lit("unknown-tool")), F.when(again, F.lit("duplicate-step")), F.when(size > MAX_STEPS, F.lit("too-many-steps")),
        F.when(~F.col("input_kind").isin("source", "step"), F.lit("bad-input")),
    ))).select("recipe_id", "pos", F.explode("errors").alias("error"))
    edges = steps.filter("input_kind = 'step'").select("recipe_id", "pos", F.col("input_ref").alias("step_id"))
    makers = steps.groupBy("recipe_id", "step_id").agg(F.min("pos").alias("made"), F.min_by("tool", "pos").alias("maker"))
    joined = edges.join(makers, ["recipe_id", "step_id"], "left")
    error = F.when(F.col("made").isNull(), "missing-step").when(F.col("made") >= F.col("pos"), "forward-edge").when(~F.col("maker").isin(*CHAINABLE), "not-chainable")
    return own.union(joined.select("recipe_id", "pos", error.alias("error")).filter("error IS NOT NULL"))


def run_recipe(source: DataFrame, steps: list[tuple[str, str, dict]], tools: dict[str, Callable[..., DataFrame]]) -> DataFrame:
    """Applies (input, tool, options) in order; an input is "source" or the place of an earlier step.
    Nothing runs until the result is used, so the whole chain is one plan."""
    made = {"source": source}
    for k, (of, tool, options) in enumerate(steps):
        if of not in made:
            raise ValueError(f"step {k} takes {of}, which no earlier step makes")
        made[str(k)] = tools[tool](made[of], **options)
    return made[str(len(steps) - 1)] if steps else source
