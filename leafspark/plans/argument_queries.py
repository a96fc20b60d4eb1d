"""The query of tool arguments, and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafspark.operators.arguments import argument_checks
from leafspark.sources.tables import table

#: tool, field, kinds, required, minimum, maximum, shortest, longest, allowed, fallback.
FIELDS = (
    ("click", "k", ["integer"], True, 10.0, 60.0, None, None, None, None), ("click", "name", ["string"], False, None, None, 1, 4, None, "none"), ("view", "k", ["number", "null"], True, None, 50.5, None, None, None, None),
    ("view", "mode", ["string"], False, None, None, None, None, ["fast", "slow"], "slow"), ("error", "k", ["integer"], False, 0.0, None, None, None, None, "7"), ("signup", "k", [], True, None, None, None, None, None, None),
)
_SHAPES = (
    "props", "'{\"k\": \"' || CAST(event_id AS STRING) || '\", \"name\": \"abcdef\"}'", "'{\"k\": null, \"mode\": \"fast\"}'", "'{\"k\": 1.5, \"mode\": \"odd\", \"name\": \"\"}'", "'{\"name\": [\"a\"], \"mode\": 3}'", "'[1]'", "'{\"k\": '", "'{\"k\": true, \"name\": \"ok\"}'",
    "'{\"k\": \"ten\"}'",
)
_CALLS = "SELECT event_id AS call, event_type AS tool, CASE event_id % 9 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_SHAPES)) + " END AS args FROM "


def tool_arguments(s, d):
    """Events as calls of tools; most have arguments that are wrong in some way."""
    calls = s.sql(_CALLS.replace("{", "{{").replace("}", "}}") + "{events}", events=table(s, d, "events"))
    fields = s.createDataFrame(list(FIELDS), "tool string, field string, kinds array<string>, required boolean, minimum double, maximum double, shortest int, longest int, allowed array<string>, fallback string")
    out = argument_checks(calls, F.broadcast(fields))
    return out.select("call", "field", "violation", F.coalesce(F.col("mended").try_cast("double").cast("string"), F.col("mended")).alias("mended"))


def _value(x) -> str:
    if isinstance(x, list):
        return "[" + ", ".join(f"'{v}'" for v in x) + "]::VARCHAR[]"
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower()


def _wrong(kind: str, value: str) -> str:
    return f"""CASE WHEN allowed IS NOT NULL AND NOT ({kind} = 'string' AND coalesce(list_contains(allowed, text), false)) THEN 'enum'
  WHEN NOT (len(kinds) = 0 OR list_contains(kinds, {kind}) OR ({kind} = 'number' AND list_contains(kinds, 'integer') AND {value} = floor({value}))) THEN 'type'
  WHEN {kind} = 'number' AND {value} < minimum THEN 'minimum' WHEN {kind} = 'number' AND {value} > maximum THEN 'maximum'
  WHEN {kind} = 'string' AND length(text) < shortest THEN 'short' WHEN {kind} = 'string' AND length(text) > longest THEN 'long' END"""


SQL = {
    "tool_arguments": f"""WITH c AS ({_CALLS} events),
f(tool, field, kinds, required, minimum, maximum, shortest, longest, allowed, fallback) AS (VALUES {", ".join("(" + ", ".join(map(_value, f)) + ")" for f in FIELDS)}),
o AS (SELECT *, json_valid(args) AND coalesce(json_type(CASE WHEN json_valid(args) THEN args END) = 'OBJECT', false) AS ok FROM c),
x AS (SELECT call, f.*, json_extract(args, '$.' || field) AS j, json_extract_string(args, '$.' || field) AS text FROM o JOIN f USING (tool) WHERE ok),
k AS (SELECT *, CASE json_type(j) WHEN 'NULL' THEN 'null' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE CASE WHEN j IS NULL THEN NULL ELSE 'number' END END AS kind FROM x),
n AS (SELECT *, CASE WHEN kind = 'number' THEN text::DOUBLE END AS number, kind IS NULL OR (kind = 'null' AND NOT list_contains(kinds, 'null')) AS absent FROM k),
v AS (SELECT *, CASE WHEN absent THEN CASE WHEN required THEN 'missing' END ELSE {_wrong("kind", "number")} END AS violation,
             coalesce(CASE WHEN kind = 'string' AND (list_contains(kinds, 'number') OR list_contains(kinds, 'integer')) THEN try_cast(text AS DOUBLE) END, number) AS value FROM n),
b AS (SELECT *, CASE WHEN value IS NOT NULL THEN 'number' ELSE kind END AS now, least(greatest(value, coalesce(minimum, value)), coalesce(maximum, value)) AS bound FROM v),
m AS (SELECT *, CASE WHEN violation IS NULL OR absent THEN NULL WHEN ({_wrong("now", "bound")}) IS NULL THEN bound::VARCHAR ELSE fallback END AS mended FROM b)
SELECT call, field, violation, coalesce(try_cast(mended AS DOUBLE)::VARCHAR, mended) AS mended FROM m UNION ALL SELECT call, NULL, 'no-object', NULL FROM o WHERE NOT ok""",
}
QUERIES = {"tool_arguments": tool_arguments}
