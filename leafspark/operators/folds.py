"""Ordered folds: what each row gives depends on what the rows before it made of a small state.

Groups stream through tasks in order, one after the other, so a task holds one batch and one state and
never a group. What needs only neighbours or sums belongs into a window instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` dealt by document, always to the same number of tasks: what is dealt so needs no shuffle to meet, by
    document, page or less."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)``, with the value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def exploded(array: Column | str) -> Column:
    """A row for each element. Of a bare column Spark would infer that it isn't empty, ahead of the column's own
    steps, and take these twice."""
    return F.explode(F.transform(array, lambda x: x))


def runs(array: Column, key: Callable[[Column], Column]) -> Column:
    """An array of arrays, cut where ``key`` differs from that of the element before."""
    starts = lambda a: F.array_compact(F.transform(a, lambda x, i: F.when((i == 0) | (key(x) != key(F.get(a, i - 1))), i)))
    cut = lambda a, at: F.transform(at, lambda s, k: F.slice(a, s + 1, F.coalesce(F.get(at, k + 1), F.size(a)) - s))
    return bound(array, lambda a: bound(starts(a), lambda at: cut(a, at)))


def folded(rows: DataFrame, keys: list[str], order: list[str], reads: list[str], gives: str, step: Callable, small: bool = False) -> DataFrame:
    """``rows`` with the columns ``gives`` ("a int, b double").

    ``step(state, *values)`` takes the state, None at the start of each group of equal ``keys``, and the
    values of ``reads`` in the group's ``order``; it returns the next state and the new columns' values.
    Groups that are ``small``, a page at most, are brought together by a window, which shuffles only rows that
    don't lie together yet.
    """
    new = _parse_datatype_string(gives)
    kinds = [f.type for f in to_arrow_schema(new)]
    names, width = [*rows.columns, *new.names], len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state = None, None
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            for values in zip(*(batch.column(c).to_pylist() for c in [*keys, *reads]), strict=True):
                if values[:width] != group:
                    group, state = values[:width], None
                state, made = step(state, *values[width:])
                for column, value in zip(out, made, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], names=names)

    if small:
        sorted_ = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        names.insert(len(rows.columns), "_nth")
        return sorted_.mapInArrow(run, StructType([*sorted_.schema.fields, *new.fields])).drop("_nth")
    sorted_ = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    return sorted_.mapInArrow(run, StructType([*rows.schema.fields, *new.fields]))
