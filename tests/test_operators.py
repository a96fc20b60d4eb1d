"""Rules that the queries don't reach, on small fixtures."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from leafspark.functions import text as T
from leafspark.operators import conversations, pages, quota
from leafspark.plans import recipes
from leafspark.sources import tables
from leafspark.streaming import quota as stream


def test_long_numbers_are_not_cut(spark):
    row = spark.range(1).select(T.padded(F.lit(123456), 3).alias("a"), T.padded(F.lit(7), 3).alias("b")).first()
    assert (row.a, row.b) == ("123456", "007")


def test_numbers_have_as_many_digits_as_the_total(spark):
    stem = T.rename_stem(F.lit("{n}-{total}"), F.lit("a.pdf"), F.lit("t"), F.lit(7), F.lit(1_200_000), F.lit("2024-03-05").cast("timestamp"))
    assert spark.range(1).select(stem.alias("x")).first().x == "0000007-1200000"


def test_fnv_of_a_known_text(spark):
    assert spark.range(1).select(T.fnv_id(F.lit("abc")).alias("x")).first().x == "07aigaz"


def test_magic_kinds(spark):
    data = [(bytearray(b"%PDF-1.7"),), (bytearray(b"\xff\xd8\xff\xe0"),), (bytearray(b"\x89PNG\r\n\x1a\n1"),), (bytearray(b"zip"),)]
    kinds = [r.k for r in spark.createDataFrame(data, "d binary").select(T.magic_kind(F.col("d")).alias("k")).collect()]
    assert kinds == ["pdf", "jpg", "png", None]


def test_bad_ranges_are_named(spark):
    bad = pages.bad_ranges(spark.createDataFrame([("1,x,3-4,-,a-b", 9)], "spec string, page_count int"))
    assert sorted(r.part for r in bad.collect()) == ["a-b", "x"]


def test_text_sink_and_files(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a\nb\nc\nd\ne")], "doc_id long, text string")
    tables.write_text(tables.doc_pages(docs), str(tmp_path / "out"))
    found = tables.read_files(spark, str(tmp_path / "out" / "*.txt")).collect()
    assert [bytes(r.data) for r in found if r.data] == [b"a\nb\nc\nd\n\ne\n"]


def test_newest_user_turn_is_the_cut_when_all_are_too_large(spark):
    turns = spark.createDataFrame([(1, 0, "user", "x" * 90), (1, 1, "assistant", "y" * 90)], "conv_id long, turn long, role string, text string")
    assert conversations.compaction_cut(turns, 100, 10).first().cut == 0


def test_quota_of_one_large_subject_is_not_gathered(spark):
    rng = random.Random(4)
    rows = [(1 if rng.random() < 0.9 else k % 50, k, float(rng.randrange(400_000)), float(rng.randrange(9))) for k in range(30_000)]
    found = quota.verdicts(spark.createDataFrame(rows, "subject long, event_id long, t double, bytes double").repartition(3), 3, 2000, 5000.0)
    assert "collect_list" not in found._jdf.queryExecution().toString()
    wanted, held = set(), {}
    for own, event, t, n in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        wanted.add((own, event, *quota.judge(held.setdefault(own, [None, 0, None, 0, None, 0.0]), t, n, (3, 2000, 5000.0))))
    assert {tuple(r) for r in found.collect()} == wanted
    assert {r[2] for r in wanted} == {"ok", "minute", "day", "bytes"}


def test_stream_and_batch_quotas_agree(spark, tmp_path):
    events = [(s, i, float(t), float(b)) for i, (s, t, b) in enumerate([(1, 0, 5), (1, 1, 5), (1, 2, 90), (1, 61, 5), (2, 0, 101), (2, 3, 50), (1, 62, 1), (1, 63, 1)])]
    schema = "subject long, event_id long, t double, bytes double"
    spark.createDataFrame(events, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    query = (
        stream.verdict_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 3, 10, 100.0)
        .writeStream.format("memory").queryName("verdicts").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    )
    query.processAllAvailable()
    query.stop()
    got = {tuple(r) for r in spark.table("verdicts").collect()}
    assert got == {tuple(r) for r in quota.verdicts(spark.read.parquet(str(tmp_path / "in")), 3, 10, 100.0).collect()}
    assert {r[2] for r in got} == {"ok", "minute", "bytes"} or {r[2] for r in got} == {"ok", "bytes"}


def test_recipes_run_in_order_and_refuse_later_inputs(spark):
    source = spark.createDataFrame(pd.DataFrame({"x": [1, 2, 3]}))
    tools = {"keep": lambda df, least: df.filter(F.col("x") >= least), "add": lambda df, n: df.withColumn("x", F.col("x") + n)}
    out = recipes.run_recipe(source, [("source", "add", {"n": 1}), ("0", "keep", {"least": 3})], tools)
    assert sorted(r.x for r in out.collect()) == [3, 4]
    with pytest.raises(ValueError, match="no earlier step"):
        recipes.run_recipe(source, [("1", "add", {"n": 1})], tools)
