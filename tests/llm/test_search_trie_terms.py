"""Top-k search, prefix trie and source divergence against brute force, with odd rows."""

import functools
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from leafspark.llm import cover_tree, divergence, prefix_trie
from tests.conftest import SF_DIR
from tests.test_queries import normal, run_sql


@pytest.mark.parametrize("module", [cover_tree, prefix_trie, divergence])
def test_same_as_sql(spark, module):
    for name, query in module.QUERIES.items():
        assert normal(query(spark, SF_DIR).toPandas()) == normal(run_sql(module.SQL[name]))


# ---------------------------------------------------------------- search


def brute_top(rows, every, k):
    wide = max((len(v) for _, v in rows), default=0)
    grid = [(i, [*v, *[0] * (wide - len(v))]) for i, v in rows]
    out = []
    for at, (q, v) in enumerate(grid):
        if q is None or q % every:
            continue
        scores = [(-sum(a * b for a, b in zip(v, w, strict=True)), c is None, c or 0) for n, (c, w) in enumerate(grid) if n != at]
        out += [(q, r + 1, None if none else c, -s) for r, (s, none, c) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def found_top(spark, rows, **sizes):
    frame = spark.createDataFrame(rows, "vec_id long, v array<long>").repartition(3)
    return sorted(map(tuple, cover_tree.top_k(frame, every=5, k=4, **sizes).collect()), key=str)


def clouds(rng, n, width, big=100):
    middles = [[rng.randrange(-big, big) for _ in range(width)] for _ in range(5)]
    return [(i, [c + rng.randrange(-9, 9) for c in rng.choice(middles)]) for i in range(n)]


@pytest.mark.parametrize("sample, slot", [(4096, 1 << 16), (40, 20), (3, 7)])
def test_search_same_as_brute_force(spark, sample, slot):
    rng = random.Random(4)
    rows = clouds(rng, 300, 6)
    rows += [(1000 + i, [7, 7, 7, 7, 7, 7]) for i in range(80)]  # copies: ties by id
    rows += [(None, rows[3][1]), (None, [0] * 6), (10, [1, 2]), (10, [1, 2]), (2000, []), (2005, [0] * 6), (2010, [-(10**4)] * 6)]
    assert found_top(spark, rows, sample_rows=sample, slot_rows=slot) == brute_top(rows, 5, 4)


def test_search_of_few_and_none(spark):
    for rows in ([], [(5, [1])], [(5, [1]), (6, [2])], [(1, [1]), (2, [2])], [(5, []), (6, [])]):
        assert found_top(spark, rows) == brute_top(rows, 5, 4)


def test_search_beyond_exact_floats(spark):
    big = 2**30 + 1
    rows = [(5, [big, 1]), (6, [big, 3]), (7, [big, 2]), (8, [-big, 9]), (9, [big - 1, 5]), (11, [0, 0])]
    assert found_top(spark, rows) == brute_top(rows, 5, 4)
    with pytest.raises(ValueError):
        found_top(spark, [(5, [2**32])])


def test_cover_tree_holds_its_radii():
    points = np.array([v for _, v in clouds(random.Random(1), 700, 4)], dtype=float)
    tree = cover_tree.build(points, leaf=10, fan=4)
    assert sorted(tree.order) == list(range(700))
    for node, below in enumerate(tree.children):
        own = tree.order[tree.start[node] : tree.end[node]]
        away = cover_tree.distances(points[own], points[tree.centre[node]])
        assert tree.centre[node] in own and np.isclose(away.max(), tree.radius[node])
        if below:
            centres = points[tree.centre[below]]
            scale = max(tree.radius[b] for b in below)
            apart = min((np.linalg.norm(a - b) for i, a in enumerate(centres) for b in centres[:i]), default=scale)
            assert tree.centre[node] in tree.centre[below] and apart >= scale - 1e-9
            assert sorted(x for b in below for x in tree.order[tree.start[b] : tree.end[b]]) == sorted(own)


def test_grid_leaves_out_unusable_vectors(spark):
    bad = [None, [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [float("-inf"), 0.0]]
    rows = [(i, v) for i, v in enumerate([*bad, [0.5, -0.0001], []])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit("clash")).withColumn("row", F.lit(1))
    got = {r["vec_id"]: r["v"] for r in cover_tree.on_grid(frame).collect()}
    assert got == {5: [512, -1], 6: []}


# ---------------------------------------------------------------- trie


def brute_trie(rows):
    """``rows(conv_id, turn, role, text)`` of the contract, by a dictionary of prefixes."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs[c].append(((turn is not None, turn or 0), mark, (role, text)))
    convs = {c: [t for _, _, t in sorted(x)] for c, x in convs.items()}
    built = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(convs.get(c - c % 20, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    out = []
    for key, ids in members.items():
        below = [k for k in members if k[: len(key)] == key]
        leaf = lambda k: not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in members)
        words = lambda k: len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        ends = ",".join(map(str, sorted(c for c in ids if built[c] == key)))
        out.append((
            min(ids), len(key), min(members[key[:-1]]) if key else None, len(ids), sum(len(k) == len(key) + 1 for k in below),
            sum(map(leaf, below)), sum((len(members[k]) - 1) * words(k) for k in below), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def found_trie(spark, rows, parts, **sizes):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("clash")).withColumn("first", F.lit(0))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        nodes = prefix_trie.prefix_trie(prefix_trie.family_heads(prefix_trie.turn_arrays(frame)), **sizes)
        return sorted(map(tuple, nodes.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("parts", ["1", "4", "23"])
def test_trie_same_as_brute_force(spark, parts):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", None]), rng.choice(["a b", "a", "", "c d e"])) for c in range(120) for t in range(rng.randrange(1, 5))]
    rows += [(c, t, "user", f"common {t}") for c in range(200, 320) for t in range(6)]  # copies cross partitions
    rows += [(c, t, "user", "deep") for c in (400, 401) for t in range(40)] + [(7, None, "x", "null turn first"), (None, 0, "x", "no id"), (999, 0, None, None)]
    rows += [(8, 1, "b", "tie"), (8, 1, "a", "tie"), (8, 1, "a", "tie")]
    assert found_trie(spark, rows, parts) == brute_trie(rows)


def test_trie_of_nothing_and_of_turnless(spark):
    assert found_trie(spark, [], "2") == []
    for rows in ([(41, 0, "u", "x")], [(c, 0, "u", "x") for c in range(41, 60)], [(1, t, None, "one two") for t in range(9)]):
        assert found_trie(spark, rows, "3", piece=3) == brute_trie(rows)


def test_ends_in_pieces():
    node = prefix_trie._Node(b"", 0, 0, False)
    for piece in (b",1", b"2,1", b"", b"3,14"):
        node.hash(piece)
    assert node.sha.hexdigest() == hashlib.sha256(b"12,13,14").hexdigest()


# ---------------------------------------------------------------- divergence


def brute_divergence(rows, least, top):
    texts = [(r[2] or "", r[3] or "", [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r[1] or "")]) for r in rows]
    out = []
    for lang in {x[0] for x in texts}:
        docs, counts = Counter(), defaultdict(Counter)
        for _, source, terms in (x for x in texts if x[0] == lang):
            docs.update(set(terms))
            counts[source].update(terms)
        kept = [t for t, n in docs.items() if n >= least]
        total = Counter(t for c in counts.values() for t in c.elements() if t in set(kept))
        share = lambda c: (lambda n: {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept})(sum(c[t] for t in kept))
        p, q = {s: share(c) for s, c in counts.items()}, share(total)
        for s in counts:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in counts if o != s)
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, i.decode(), -v, n + 1) for part, x in (("pair", pairs), ("term", terms)) for n, (v, i) in enumerate(x)]
    return sorted(out)


DOCS = (
    [(i, " ".join(random.Random(i).choices(["The", "the", "größe", "Ünï", "x1y", "naïve-té", "日本", "a", "Zz", "rare" + chr(97 + i % 26)], k=i % 17)), ["en", "de", None][i % 3], f"s{i % 4}") for i in range(150)]
    + [(None, "a a a", "en", "s0"), (1, None, "en", "only null"), (2, "", "xx", "s1"), (2, "12 34", "xx", "s2"), (3, "solo", "yy", None), (3, "solo", "yy", None), (4, "w" * 70000 + " a", "en", "s1")]
    + [(500 + i, "hot", "en", "s2") for i in range(40)]
)


@pytest.mark.parametrize("sizes", [{}, {"entries": 5, "piece": 8, "cells": 3}])
def test_divergence_same_as_brute_force(spark, sizes):
    frame = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string")
    frame = functools.reduce(lambda f, c: f.withColumn(c, F.lit("clash")), ("term", "n", "docs", "key", "part", "item", "value", "rank"), frame).repartition(3)
    got = sorted(map(tuple, divergence.divergence(frame, min_docs=3, top=4, **sizes).collect()))
    assert got == brute_divergence(DOCS, 3, 4)


def test_divergence_of_nothing(spark):
    frame = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert divergence.divergence(frame).collect() == []


def test_share_is_exact():
    total = 9 * 10**15 - 7
    counts = np.array([0, 1, 12345, total // 3, total - 1, total], dtype=np.int64)
    assert divergence.share(counts, total).tolist() == [1 + 10**9 * int(c) // total for c in counts]


def test_crc_of_sql_is_the_one_of_the_contract():
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations AS SELECT i AS conv_id, 0 AS turn, 'u' AS role, 'x' AS text FROM range(300) t(i)")
    sql = prefix_trie.SQL["op12_prefix_trie"]
    heads = con.execute(sql[: sql.index("),\nr AS (")] + ") SELECT conv_id, h FROM c").fetchall()
    assert all(h == zlib.crc32(str(c).encode()) % 4 for c, h in heads)
