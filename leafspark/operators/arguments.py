"""Arguments of tool calls against their tools' fields: what is missing or wrong, and what can be mended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A call's own violation: its arguments aren't an object of JSON.
NO_OBJECT = "no-object"


def _kind(schema: Column) -> Column:
    """The JSON kind of a value by its variant's schema."""
    return (
        F.when(schema.isNull(), F.lit(None).cast("string")).when(schema == "VOID", "null").when(schema == "STRING", "string").when(schema == "BOOLEAN", "boolean")
        .when(F.startswith(schema, F.lit("ARRAY")), "array").when(F.startswith(schema, F.lit("OBJECT")), "object").otherwise("number")
    )


def argument_checks(calls: DataFrame, fields: DataFrame) -> DataFrame:
    """``calls(call, tool, args)``, arguments as JSON text, against ``fields(tool, field, kinds, required, minimum,
    maximum, shortest, longest, allowed, fallback)``: kinds are JSON's and "integer", allowed and fallback are
    strings or null. One row for each call and field of its tool, and one without field for a call whose arguments
    aren't an object: ``violation`` (the first of missing, enum, type, minimum, maximum, short, long; null for none),
    and ``mended``: a numeric text as a number, a number brought between the bounds, or the fallback, where
    the value would be wrong without. Absent fields that aren't required are fine; null is absent unless
    the kinds name it. Arguments are exploded once, and meet the fields by tool and name."""
    parsed = calls.select("call", "tool", F.try_parse_json("args").alias("v"))
    parsed = parsed.withColumn("object", F.coalesce(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), F.lit(False)))
    broken = parsed.filter("NOT object").select("call", F.lit(None).cast("string").alias("field"), F.lit(NO_OBJECT).alias("violation"), F.lit(None).cast("string").alias("mended"))
    whole = parsed.filter("object")
    view = f"calls_{abs(id(calls))}"
    whole.createOrReplaceTempView(view)
    given = calls.sparkSession.sql(f"SELECT call, x.key AS field, schema_of_variant(x.value) AS schema, try_variant_get(x.value, '$', 'double') AS number, try_variant_get(x.value, '$', 'string') AS text FROM {view}, LATERAL variant_explode(v) AS x")
    rows = whole.select("call", "tool").join(fields, "tool").join(given, ["call", "field"], "left")
    number, text, is_in = F.col("number"), F.col("text"), lambda kind: F.array_contains("kinds", kind)
    rows = rows.withColumn("kind", _kind(F.col("schema"))).withColumn("any", F.size("kinds") == 0)
    rows = rows.withColumn("absent", F.col("kind").isNull() | ((F.col("kind") == "null") & ~is_in("null")))
    numeric = F.when((F.col("kind") == "string") & (is_in("number") | is_in("integer")), text.try_cast("double"))

    def wrong(kind: Column, value: Column, word: Column) -> Column:
        fits = F.col("any") | F.array_contains("kinds", kind) | ((kind == "number") & is_in("integer") & (value == F.floor(value)))
        return (
            F.when(F.col("allowed").isNotNull() & ~((kind == "string") & F.coalesce(F.array_contains("allowed", word), F.lit(False))), "enum").when(~fits, "type")
            .when((kind == "number") & (value < F.col("minimum")), "minimum").when((kind == "number") & (value > F.col("maximum")), "maximum")
            .when((kind == "string") & (F.length(word) < F.col("shortest")), "short").when((kind == "string") & (F.length(word) > F.col("longest")), "long")
        )

    found = F.when(F.col("absent"), F.when(F.col("required"), "missing")).otherwise(wrong(F.col("kind"), number, text))
    rows = rows.withColumn("violation", found).withColumn("value", F.coalesce(numeric, F.when(F.col("kind") == "number", number)))
    bound = F.least(F.greatest("value", F.coalesce("minimum", "value")), F.coalesce("maximum", "value"))
    still = wrong(F.when(F.col("value").isNotNull(), "number").otherwise(F.col("kind")), bound, text)
    mended = F.when(F.col("violation").isNull() | F.col("absent"), F.lit(None).cast("string")).when(still.isNull(), bound.cast("string")).otherwise(F.col("fallback"))
    return rows.select("call", "field", "violation", mended.alias("mended")).union(broken)
