"""Verbatim copies of items that templates cannot search for."""

import pytest

pytest.importorskip("quernstone.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from quernstone.llm import queries  # noqa: E402

BENCH = [(1, "1 2 3 4 5 6 7 8 9 10"), (2, "7 + 5"), (3, "tiny item"), (4, None), (5, ""), (6, "a table of 3 kg 4 kg 5 kg 6 kg 7 kg 8 kg and then it ends with plain words only")]
DOCS = [
    (1, "x " * 50 + "1 2 3 4 5 6 7 8 9 10 11"), (2, "so (7 + 5)!"), (3, "A tiny item"), (4, None), (5, ""), (6, "Q: a table of 3 kg 4 kg 5 kg 6 kg 7 kg 8 kg and"),
    (7, "1 2 3 4 5 6 7 9 8 10"), (8, "tiny items, item tiny"), (9, "a table of 9 kg 9 kg 5 kg"), (None, "tiny item"), (10, "tiny item"), (10, "tiny item"),
]


def test_slot_heavy_and_short_items(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in queries.op4_template_decontamination(spark, str(tmp_path)).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (6, 6), (None, 3), (10, 3)}
    left = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in left.collect()) == [4, 5, 7, 8, 9]
    assert corpus_pipeline.decontamination(spark, docs.limit(0), str(tmp_path)).count() == 0
