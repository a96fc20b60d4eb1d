import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from leafspark.llm import components, exact_dedup, merkle, mixing, repeats, simhash
from tests.conftest import SF_DIR
from tests.llm.conftest import ROWS
from tests.test_queries import normal, run_sql


@pytest.mark.parametrize("module", [exact_dedup, merkle, mixing])
def test_same_as_sql(spark, module):
    for name, sql in module.SQL.items():
        assert normal(module.QUERIES[name](spark, SF_DIR).toPandas()) == normal(run_sql(sql))


@pytest.mark.parametrize("hot", [10_000, 1, 2])
def test_exact_groups_of_odd_rows(docs, hot):
    rows = exact_dedup.duplicate_groups(docs, hot=hot).collect()
    texts = [(i, re.sub(r"[\x20\x09-\x0D]", "", t or ""), len(t or "")) for i, t, _, _ in ROWS]
    assert len(rows) == len(ROWS)
    for r in rows:
        own = {x[1] for x in texts if x[0] == r.doc_id and hashlib.sha256(x[1].encode()).hexdigest() == r.text_sha256}
        group = [x for x in texts if x[1] in own]
        best = min(group, key=lambda x: (-x[2], x[0] is None, x[0] or 0))
        assert (r.keep_id, r.group_size) == (best[0], len(group))
    assert sum(r.kept for r in rows) == len({x[1] for x in texts})


def test_sort_brings_equals_together(spark, docs):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    norms = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in documents.collect()]
    # Every row but the first of its text was compared with an equal neighbour.
    placed = exact_dedup.sorted_runs(documents)
    assert placed.filter("place > 1").count() == len(norms) - len(set(norms)) > 0
    # A hot text is cut into runs, and they are stitched.
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("hot text"), F.repeat(F.lit(" "), (F.col("id") % 5).cast("int")))).otherwise(F.col("id").cast("string")).alias("text"))
    assert exact_dedup.sorted_runs(many, hot=100).filter("place = 1 AND norm = 'hottext'").count() == 10
    group = exact_dedup.duplicate_groups(many, hot=100).filter("group_size > 1").collect()
    assert len(group) == 1000 and {(r.keep_id, r.group_size) for r in group} == {(9, 1000)} and [r.doc_id for r in group if r.kept] == [9]


def test_exact_dedup_with_any_column_names(docs):
    clashing = docs.withColumns({c: F.lit("own") for c in ("_key", "_place", "row", "size", "mark", "part", "best_part", "head")})
    kept = exact_dedup.exact_dedup(clashing)
    assert kept.columns == clashing.columns and kept.filter("_key = 'own' AND _place = 'own' AND head = 'own'").count() == exact_dedup.exact_dedup(docs).count()


def test_exact_dedup_keeps_whole_rows_once(docs):
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, _, _ in ROWS})


def brute_components(prints):
    ids = [k for k, _ in prints]
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a][1] ^ prints[b][1]).count("1") <= 3:
                parent[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted((str(i), str(least.get(find(k)))) for k, i in enumerate(ids))


@pytest.mark.parametrize("crowd", [1000, 1])
def test_near_components(docs, crowd):
    found = simhash.near_components(docs, crowd=crowd).collect()
    prints = [(i, simhash.fingerprint_of(t) & (1 << 64) - 1) for i, t, _, _ in ROWS]
    assert sorted((str(r.doc_id), r.fingerprint) for r in found) == sorted((str(i), f"{p:016x}") for i, p in prints)
    assert sorted((str(r.doc_id), str(r.component_id)) for r in found) == brute_components(prints)


def test_no_link_within_three_bits_is_lost(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = list({p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for p in base for _ in range(12)})
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    wanted = brute_components(list(enumerate(prints)))
    for crowd in (1000, 3):
        frame = spark.createDataFrame(signed, "fp long")
        labels = dict(components.components(simhash.near_links(frame, crowd)).collect())
        groups = {}
        for k, (p,) in enumerate(signed):
            groups.setdefault(labels.get(p, p), []).append(k)
        assert sorted((str(k), str(min(g))) for g in groups.values() for k in g) == wanted


def test_fingerprints_by_the_bits(spark):
    import xxhash

    text = "One two three FOUR four"
    h = [xxhash.xxh64(x, seed=42).intdigest() for x in (b"one two three", b"two three four", b"three four four")]
    assert simhash.fingerprint_of(text) & (1 << 64) - 1 == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 3)
    # The hash is that of the SQL function.
    sql = spark.range(1).select(F.xxhash64(F.lit("one two three")).alias("x")).first().x
    assert sql & (1 << 64) - 1 == h[0]


def test_components_of_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(200, 260)] + [(1, k) for k in range(2, 60)] + [(500, 500), (61, 60)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {k: got[k] for k in (260, 200, 59, 1, 61)} == {260: 200, 200: 200, 59: 1, 1: 1, 61: 60}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(rows):
    out = []
    for i, t, _, _ in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 49):
            if i is not None and any(j is not None and j < i and data[p : p + 50] in (u or "").encode() for j, u, _, _ in rows):
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((str(i), len(data), sum(gone), spans, kept))
    return sorted(out)


def test_repeats(docs):
    got = repeats.repeat_spans(docs).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == brute_repeats(ROWS)


def test_repeats_in_parts(spark, monkeypatch):
    rng = random.Random(3)
    shared = ["".join(rng.choice("abcd ") for _ in range(rng.randint(40, 200))) for _ in range(12)]
    rows = [(k, "".join(rng.choice(shared) if rng.random() < 0.6 else "".join(rng.choice("wxyz") for _ in range(30)) for _ in range(8)), "", "") for k in range(40)]
    for name, value in (("BLOCK_BYTES", 3000), ("STRIDE", 256), ("LONGEST", 7), ("PART_BYTES", 5000)):
        monkeypatch.setattr(repeats, name, value)
    # Workers import the module anew, so the small sizes only hold for what runs here.
    got = repeats.repeat_spans(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(2)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == brute_repeats(rows)


def brute_tree(text):
    cut = re.sub(r"([^ \n]{8,} )", "\\1\x01", text)
    for end in (". ", "! ", "? "):
        cut = cut.replace(end, end + "\x01")
    sha = lambda tag, x: hashlib.sha256((tag + x).encode()).hexdigest()
    lines = [[sha("L", leaf) for leaf in line.split("\x01")] for line in cut.replace("\n", "\n\x02").split("\x02")]
    paragraphs, sections, own = [(sha("P", "".join(x)), x) for x in lines], [], []
    for k, p in enumerate(paragraphs):
        own.append(p)
        if p[0] < "4" or k == len(paragraphs) - 1:
            sections.append((sha("S", "".join(h for h, _ in own)), own))
            own = []
    return sha("R", "".join(h for h, _ in sections)), sections


def brute_edits(a, b):
    if a[0] == b[0]:
        return []
    known = {h for h, _ in a[1]}
    sections = [ps for h, ps in a[1] if h not in {h for h, _ in b[1]}]
    paragraphs, leaves = {h for ps in sections for h, _ in ps}, {x for ps in sections for _, own in ps for x in own}
    return [(i, k, n) for i, (h, ps) in enumerate(b[1]) if h not in known for k, (g, own) in enumerate(ps) if g not in paragraphs for n, x in enumerate(own) if x not in leaves]


def test_merkle_locates_edits(spark):
    rng = random.Random(5)
    lines = [" ".join(rng.choice(["word", "something", "end.", "Yes!", "considerable"]) + str(rng.randint(0, 99)) for _ in range(30)) for _ in range(60)]
    other = [*lines[:20], "a new line of words. And more", *lines[20:40], lines[40].replace("word", "WORD", 1), *lines[41:]]
    rows = [("\n".join(lines), "\n".join(other)), ("same", "same"), ("", "x. y"), ("\n\n", "\n"), (" ".join(lines), " ".join(other))]
    frame = spark.createDataFrame(rows, "a string, b string")
    for c in "ab":
        frame = merkle.with_fingerprint(merkle.with_tree(frame, F.col(c), f"t{c}"), F.col(c), f"f{c}")
    got = frame.select("*", merkle.edited_leaves(F.col("ta"), F.col("tb")).alias("e"), merkle.likeness(F.col("fa"), F.col("fb")).alias("n")).collect()
    for r in got:
        a, b = brute_tree(r.a), brute_tree(r.b)
        assert (r.ta.root, r.tb.root) == (a[0], b[0])
        assert [(s.hash, [(p.hash, p.leaves) for p in s.paragraphs]) for s in r.tb.sections] == b[1]
        assert [tuple(x) for x in r.e] == brute_edits(a, b)
        assert len(r.fa) <= 65 + 17 * merkle.SKETCH and 0 <= r.n <= 1
    assert [r.n for r in got if r.a == "same"] == [1.0] and [r.e for r in got if r.a == "same"] == [[]]
    whole = next(r for r in got if r.a == rows[0][0])
    assert 0 < len(whole.e) < 12 and whole.n > 0.9


def test_merkle_of_odd_rows(docs):
    rows = {(r.doc_id, r.n_chars): r for r in merkle.compare_edits(docs).collect()}
    texts = {i: t or "" for i, t, _, _ in ROWS}
    order = sorted((i for i in texts if i is not None), reverse=True) + [None]
    for i, after in zip(order, order[1:] + order[:1], strict=True):
        text = texts[i]
        half = len(text) // 2
        edited = text[: len(text) - half] + texts[after][:half]
        assert rows[i, len(text)].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert merkle.compare_edits(docs).count() == len(ROWS)


def test_mixture_shares_shortages_with_siblings(spark):
    leaves = spark.createDataFrame([("d0", "en", "a", 10), ("d0", "en", "b", 1000), ("d1", "en", "c", 50), ("d1", "de", "c", 1000)], "domain string, lang string, source string, supply long")
    got = {tuple(r)[:3]: r.allot for r in mixing.allotments(leaves, {}, None, 400, 1).collect()}
    # 200 a domain: a gives its 10 and b the other 190; in d1 English gives 50 and German 150.
    assert got == {("d0", "en", "a"): 10, ("d0", "en", "b"): 190, ("d1", "en", "c"): 50, ("d1", "de", "c"): 150}
    got = mixing.allotments(leaves, {}, None, 10**9, 2).collect()
    assert sum(r.allot for r in got) == 2 * 2060


def test_mixture_of_odd_rows(docs):
    whole = docs.withColumn("domain", mixing.domain_of(F.col("source")))
    rows = mixing.selections(whole, mixing.WEIGHTS, share=1.0, max_epochs=1).collect()
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _, _ in ROWS)
    assert sum(r.take_tokens for r in rows) == words
    assert mixing.mix_documents(docs, mixing.WEIGHTS, share=0.5).columns == docs.columns


def test_empty_tables(none):
    assert exact_dedup.duplicate_groups(none).count() == 0
    assert simhash.near_components(none).count() == 0
    assert repeats.repeat_spans(none).count() == 0
    assert merkle.compare_edits(none).count() == 0
    assert mixing.selections(none, {}, share=0.5).count() == 0


def test_likeness_reads_a_sketch_once(spark):
    """Not once for every hash of it."""
    shown = str(merkle.likeness(F.col("a"), F.col("b")))
    assert "array_max(filter(" not in shown
    rows = [("r:" + ",".join(x), "s:" + ",".join(y)) for x, y in (("ab", "bc"), ("", ""), ("abc", "abc"), ("a", ""))]
    found = spark.createDataFrame(rows, "a string, b string").select(merkle.likeness(F.col("a"), F.col("b")).alias("x"))
    assert [r.x for r in found.collect()] == [0.5, 0.0, 1.0, 0.0]


def test_near_dedup_by_fingerprints(spark):
    rows = [(1, "a b c d"), (2, "A b c d"), (2, "other words are here"), (None, "a b c d"), (4, None)]
    found = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(found.collect(), key=str) == sorted([r for r in rows if r != (2, "A b c d")], key=str)


def test_pipeline_drops_near_copies_by_fingerprints(spark, monkeypatch):
    import corpus_pipeline

    called = []
    monkeypatch.setattr(simhash, "near_dedup", lambda docs: called.append(docs) or docs)
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert corpus_pipeline.drop_near_copies(spark, docs, "") is docs and called == [docs]
