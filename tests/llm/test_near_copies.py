"""Near-copy removal against brute-force Jaccard."""

import random

import pytest
from pyspark.sql import functions as F

from leafspark.llm import common, mixing, near_copies
from tests.llm.conftest import ROWS


def brute_kept(rows):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            x, y = len(sets[a]), len(sets[b])
            if group[a] == group[b] or min(x, y) * 5 < max(x, y) * 4:
                continue
            both = len(sets[a] & sets[b])
            if both * 5 >= (x + y - both) * 4:
                group = [group[a] if g == group[b] else g for g in group]
    least = {g: min((i for k, (i, _) in enumerate(rows) if group[k] == g and i is not None), default=None) for g in group}
    return sorted(str(i) for k, (i, _) in enumerate(rows) if i is None or i == least[group[k]])


def edited(rng, words, edits):
    words = list(words)
    for p in rng.sample(range(len(words)), edits):
        words[p] = f"new{rng.randrange(10**9)}"
    return " ".join(words)


@pytest.mark.parametrize("crowd", [50, 2])
def test_same_as_brute_force(spark, crowd):
    rng = random.Random(1)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for _ in range(25):
        # Half of the texts of a family share a passage with all others; five edits of 200 words stand for 0.78 or so.
        base = [f"w{rng.randrange(5000)}" for _ in range(200)] + passage * rng.randrange(2)
        rows += [edited(rng, base, rng.randrange(12)) for _ in range(8)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(str(r.doc_id) for r in near_copies.near_dedup(frame, crowd=crowd).collect()) == brute_kept(rows)


def test_odd_rows(docs, none):
    kept = near_copies.near_dedup(docs)
    assert kept.columns == docs.columns
    wanted = brute_kept([(i, t) for i, t, _, _ in ROWS])
    assert sorted(str(r.doc_id) for r in kept.collect()) == wanted
    assert near_copies.near_dedup(none).count() == 0


def test_given_documents(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert sorted(str(r.doc_id) for r in near_copies.near_dedup(docs).collect()) == brute_kept(rows)


def test_a_repeated_id_loses_only_the_copy(spark):
    text, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(1, text, "x"), (2, text, "x"), (2, other, "x"), (None, text, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _gone string").withColumn("mark", F.lit("clash")).withColumn("row", F.lit(0))
    kept = near_copies.near_dedup(frame)
    assert kept.columns == frame.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == sorted([("1", text), ("2", other), ("None", text)])


def test_mixing_keeps_columns_of_any_name(spark):
    frame = spark.createDataFrame([(1, "a b", "en", "src0", "x"), (2, "c", None, None, "y")], "doc_id long, text string, lang string, source string, _taken string").withColumn("taken", F.lit(1))
    taken = mixing.mix_documents(frame, mixing.WEIGHTS, share=1.0)
    assert taken.columns == frame.columns and taken.count() == 2
    assert mixing.mix_documents(frame.filter("doc_id < 0"), mixing.WEIGHTS, share=1.0).collect() == []
