"""The pipeline's stages on a small table against brute force."""

import hashlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as C
from tallyforge.llm import decontaminate, secrets, toxicity
from tests.llm.test_near_duplicates import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from tallyforge.operators.graph import written

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, seen = docs.columns, {}
    for name, stage in C.STAGES:
        before = docs
        docs = written(stage(spark, docs, SF))
        seen[name] = (before.collect(), docs.collect())
        assert name == "bpe" or docs.columns == names
    assert [n for n, _ in C.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "bpe"]

    a, b = seen["toxicity"]
    field = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r.doc_id: r.predicted for r in toxicity.scored(spark.read.parquet(f"{SF}/documents.parquet"), field).collect()}
    assert {r.doc_id for r in b} == {r.doc_id for r in a if not scores[r.doc_id]}

    a, b = seen["near_duplicates"]
    want = {d for d, n, c in brute([(r.doc_id, r.text) for r in a], 5) if c == d}
    assert {str(r.doc_id) for r in b} == want

    a, b = seen["decontamination"]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r.doc_id for r in b} == {r.doc_id for r in a if not decontaminate.brute(r.text, items)[2]}

    a, b = seen["secrets"]
    after = {r.doc_id: r for r in b}
    assert len(a) == len(b)
    for r in a:
        out, at = "", 0
        for s, _, e in secrets.brute(r.text):
            if s >= at:
                out += r.text[at:s] + secrets.MASK
            at = max(at, e)
        out += r.text[at:]
        assert after[r.doc_id].text == out and (out == r.text or after[r.doc_id].n_chars == len(out))

    a, b = seen["bpe"]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r.doc_id: t.encode(r.text, add_special_tokens=False).ids for r in a}
    assert len(a) == len(b) and all(r.ids == ids[r.doc_id] and r.round_trip for r in b)
    assert all(r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() for r in b)


def test_odd_tables(spark):
    """Nulls, repeats, empty tables and clashing names pass through all stages."""
    rows = [(None, None, None, "a", 1), (1, "", "en", None, 2), (1, "", "en", None, 2), (2, "token: abcdefghij0 " + "w " * 5000, None, "b", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = docs.selectExpr("*", "1 AS score", "2 AS n_items", "3 AS set", "4 AS __text", "5 AS cluster", "6 AS __kept", "7 AS __kept_0", "8 AS __k0")
    for frame in (docs, clash):
        for name, stage in C.STAGES:
            out = stage(spark, frame, SF)
            assert out.count() == frame.count(), name
            assert name == "bpe" or out.columns == frame.columns
            assert stage(spark, frame.limit(0), SF).count() == 0
