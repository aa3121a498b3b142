"""The pipeline against a brute-force version of each stage, built from the operators' own brute-force versions."""

import hashlib

import numpy as np
import pytest

pytest.importorskip("quernstone.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from test_byte_bpe import want as bpe_want  # noqa: E402
from test_decontaminate import brute as brute_leaks  # noqa: E402
from test_near_copies import brute_kept  # noqa: E402
from test_simple_ops import brute_quality  # noqa: E402

from quernstone.llm import quality_gbt, secret_ledger  # noqa: E402


def test_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = quality_gbt.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    good = {}
    for i, t in rows.items():
        b = brute_quality(t)
        x = np.array([quality_gbt.statistics(t)[len(quality_gbt.COUNTS) :]], float)
        if not (b[0] < 50 or 100 * b[4] > 50 * b[0]) and (model is None or model.score(x)[0] >= 0.5):
            good[i] = t
    kept = {i: good[i] for i in brute_kept(list(good.items()))}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaks = {d for d, *_ in brute_leaks(list(kept.items()), bench)}
    left = {i: t for i, t in kept.items() if i not in leaks}
    spans = {r.doc_id: r.spans for r in secret_ledger.scan_incremental(spark.createDataFrame(list(left.items()), "doc_id long, text string"))[0].collect()}
    for i, found in spans.items():
        at, out = 0, ""
        for s in found:
            if s.start >= at:
                out += left[i][at : s.start] + "[SECRET]"
            at = max(at, s.end)
        left[i] = out + left[i][at:]
    got = corpus_pipeline.run(spark, sf).collect()
    assert 0 < len(got) < len(rows)
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == {i: bpe_want(t) for i, t in left.items()}
    assert all(hashlib.sha256(r.ids).hexdigest() == r.ids_sha256 for r in got)


def test_stages_stand_odd_rows(spark, sf):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "long word " * 200, None, "s", 5), (3, None, "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, sf)
            assert out.count() <= table.count()
            if name != "byte_level_bpe":
                assert out.columns == docs.columns
    assert corpus_pipeline.near_duplicates(spark, docs, sf).count() == 2


def test_columns_named_like_those_of_operators_stay(spark, sf):
    """What an operator adds under a name does not replace what the table has under it."""
    text = " ".join(f"word{i} and thing{i % 7}" for i in range(80))
    rows = [(1, text, 9, -5, "mine", True, "b"), (2, f"{text} password=abcdefghijklmnop", 9, -6, "yours", False, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, n_words long, spans string, kept boolean, blob string")
    empty = docs.limit(0)
    for stage in (corpus_pipeline.quality_rules, corpus_pipeline.secret_scans):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.schema == docs.schema and stage(spark, empty, sf).count() == 0
        assert {(r.doc_id, r.n_words, r.spans, r.kept, r.blob) for r in out.collect()} <= {(1, -5, "mine", True, "b"), (2, -6, "yours", False, None)}
    clean = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.secret_scans(spark, docs, sf).collect()}
    assert clean[1] == (text, 9) and clean[2] == (f"{text} [SECRET]", len(text) + 9)
