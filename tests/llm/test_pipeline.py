"""The stages of the pipeline, each on what the one before kept."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from heddle.llm.common import written
from tests.llm.test_operators import brute_classes, brute_quality

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        new = written(stage(spark, docs, SF))
        kept[name] = (docs, new)
        docs = new
    before, after = kept["quality rules"]
    for r in before.join(after.selectExpr("doc_id", "true as kept"), "doc_id", "left").collect():
        n, chars, symbols, dup, rep = brute_quality(r.text)
        if n < 50 or 100 * rep > 50 * n:
            assert r.kept is None
        elif symbols == 0 and dup == 0 and 3 <= chars / n <= 12:
            assert r.kept
    before, after = kept["toxicity"]
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    left = {r.doc_id for r in after.collect()}
    gone = {r.doc_id for r in before.collect()} - left
    assert len(gone & toxic) >= 0.8 * len({r.doc_id for r in before.collect()} & toxic)
    before, after = kept["n-gram Jaccard join"]
    want = brute_classes([tuple(r) for r in before.select("doc_id", "text").collect()], 5, 80, 100)
    assert sorted(r.doc_id for r in after.collect()) == sorted({c for _, c in want.values()})
    before, after = kept["mixing sources to target weights"]
    assert after.columns == before.columns and 0 < after.count() <= 3 * before.count()
    last = kept["BPE encoding and decoding"][1]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in last.limit(40).collect():
        assert list(np.frombuffer(r.ids, "<u4")) == library.encode(r.text, add_special_tokens=False).ids


def test_run_agrees_with_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF))
    rows = lambda df: sorted((r.doc_id, r.n_tokens, bytes(r.ids)) for r in df.collect())
    assert rows(corpus_pipeline.run(spark, SF)) == rows(docs)


def test_stages_on_odd_tables(spark):
    """Nulls, empty and very long texts, ties, repeated rows, an empty table, and columns named as the stages' own."""
    long = " ".join(f"l{i % 9000}o{i % 7}" for i in range(60_000))
    plain = " ".join(f"p{i}q" for i in range(80))
    rows = [(1, plain), (1, plain), (2, plain), (3, None), (4, ""), (None, plain), (None, None), (5, long), (6, "you are an idiot " + plain)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted int, rejected_by string, _key int, _slot int"
    odd = spark.createDataFrame([(*r, None, "s", None, "mine", 7, "me", 1, 2) for r in rows], schema)
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            assert {(r.score, r.predicted, r.rejected_by, r._key, r._slot) for r in out.collect()} <= {("mine", 7, "me", 1, 2)}, name
        last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert last.count() == docs.count() and {"n_tokens", "ids"} <= set(last.columns)
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted((-1 if r.doc_id is None else r.doc_id) for r in df.collect())
    assert ids(stage["quality rules"](spark, odd, SF)) == [-1, 1, 1, 2, 5, 6]
    assert 6 not in ids(stage["toxicity"](spark, odd, SF))
    assert ids(stage["n-gram Jaccard join"](spark, odd, SF)) == [-1, -1, 1, 3, 4, 5]
    mixed = ids(stage["mixing sources to target weights"](spark, odd, SF))
    assert not {3, 4} & set(mixed) and max(mixed.count(i) for i in (2, 5, 6)) <= 3
