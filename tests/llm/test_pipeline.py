"""The stages one by one against plain versions."""

import re

import numpy as np
import public_tokenizers
import tiktoken

import __spark_entry__
import corpus_pipeline
from leafspark.llm import byte_bpe, common, simhash
from tests.conftest import SF_DIR


def test_stages(spark):
    docs = common.table(spark, SF_DIR, "documents")
    columns, before = docs.columns, docs.toPandas()
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.staged(stage(spark, docs, SF_DIR), name)
        assert docs.columns == columns
        now = docs.toPandas()
        assert now.doc_id.is_unique and set(now.doc_id) <= set(before.doc_id) and len(now)
        kept[name] = before, now
        before = now
    a, b = kept["exact_dedup"]
    norm = a.text.map(lambda t: re.sub(r"[\x20\x09-\x0D]", "", t))
    best = a.assign(norm=norm, n=-a.text.str.len()).sort_values(["n", "doc_id"]).drop_duplicates("norm")
    assert set(b.doc_id) == set(best.doc_id)
    a, b = kept["near_dedup"]
    prints = [(i, simhash.fingerprint_of(t)) for i, t in zip(a.doc_id, a.text, strict=True)]
    near = {i for i, p in prints if not any(j < i and bin((p ^ q) & (1 << 64) - 1).count("1") <= 3 for j, q in prints)}
    # Without chains, a group is its least document's neighbours.
    assert set(b.doc_id) <= near and len(near) - len(b) <= 2
    a, b = kept["mixing"]
    # Documents that a leaf's budget cuts stay whole.
    assert len(b) < len(a)
    assert b.text.str.split().str.len().sum() >= int(0.8 * a.text.str.split().str.len().sum()) - 80
    coded = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).toPandas().set_index("doc_id")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    assert set(coded.index) == set(b.doc_id)
    for i, t in zip(b.doc_id, b.text, strict=True):
        assert np.frombuffer(coded.ids[i], "<u4").tolist() == library.encode_ordinary(t)
        assert coded.n_bytes[i] == len(t.encode())


def test_registered():
    names = __spark_entry__.queries()
    assert {re.match(r"op\d+_", n)[0] for n in names if re.match(r"op\d+_", n)} == {f"op{k}_" for k in range(1, 14)}
    assert names["pipeline"] is corpus_pipeline.run
    assert set(__spark_entry__.oracle_sql()) <= set(names)
