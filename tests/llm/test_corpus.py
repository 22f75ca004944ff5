"""The pipeline as a whole on planted copies."""

from __future__ import annotations

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.fixture(scope="module")
def real(data):
    return pq.read_table(f"{data}/documents.parquet").to_pylist()


def invented(r, lines):
    return "\n".join(" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(3, 9))) for _ in range(10)) for _ in range(lines))


def test_of_planted_exact_copies_one_document_stays(spark, data, real, tmp_path, monkeypatch):
    r = random.Random(7)
    texts = [invented(r, 1 + k % 15) for k in range(30)]
    rows = [(d["doc_id"], d["text"], d["lang"], d["source"], d["n_chars"]) for d in real]
    rows += [(10_000 + 100 * copy + k, t, "en", "src0", len(t)) for copy in range(4) for k, t in enumerate(texts)]
    rows += [(None, texts[7], "en", "src0", len(texts[7]))] * 2 + [(10_000 + 9, texts[9], "en", "src0", len(texts[9]))] * 2
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    # without mixing and packing, which draw documents several times or never
    monkeypatch.setattr(corpus_pipeline, "STAGES", [*corpus_pipeline.STAGES[:3], ("as it is", lambda spark, docs, sf_dir: docs)])
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    planted = sorted((row["doc_id"] or -1, row["text"]) for row in found if row["doc_id"] is None or row["doc_id"] >= 10_000)
    assert planted == [(10_000 + k, t) for k, t in enumerate(texts)]


def test_rows_with_equal_ids_and_with_null_ids_stay_once(spark, data):
    r = random.Random(8)
    a, b, c, d = (invented(r, 3) for _ in range(4))
    rows = [(1, a), (1, a), (2, a), (3, b), (3, b), (None, c), (None, c), (None, b), (4, d)]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in rows], SCHEMA)
    found = corpus_pipeline.drop_near_duplicates(spark, docs, data)
    assert found.columns == docs.columns
    assert sorted((x["doc_id"] or -1, x["text"]) for x in found.collect()) == [(-1, c), (1, a), (3, b), (4, d)]


def test_without_labels_documents_stay(spark, data):
    rows = [(1, "The cat.", None), (2, "日本語", None), (3, "12 !", None), (4, "", None), (5, None, None), (None, "ok", None), (6, "7", "en")]
    docs = spark.createDataFrame([(i, t, lang, "src0", 1) for i, t, lang in rows], SCHEMA)
    found = corpus_pipeline.identify_language(spark, docs, data)
    assert found.columns == docs.columns and sorted(x["text"] for x in found.collect()) == ["The cat.", "ok", "日本語"]


def test_stages_with_nothing_and_with_odd_rows(spark, data):
    """Empty tables, nulls in all columns, and columns named like the operators' results."""
    r = random.Random(9)
    names = ["lang_pred", "score", "n_lines", "n_removed_lines", "copy", "rate", "unnamed", "row", "component_id", "n_shingles", "key", "body", "sequence_id"]
    rows = [(k, invented(r, 1 + k % 4), "en", "src0", 1) for k in range(20)] + [(None,) * 5, (30, None, None, None, None), (31, "", "en", "src1", 0), (32, "12", None, "src1", 2), (33, "\n\n", "en", None, 2), (34, "w" * 50_000, "en", None, 1), (35, "long words " * 20_000, "en", "src1", 1)]
    plain = spark.createDataFrame(rows, SCHEMA)
    clash = plain.select("*", *(F.lit("own").alias(c) for c in names))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, plain.limit(0), data).count() == 0, name
        assert stage(spark, clash.limit(0), data).count() == 0, name
        found, same = stage(spark, clash, data), stage(spark, plain, data)
        if name == "best_fit_packing":
            assert found.count() == same.count() > len(rows)
            continue
        assert found.columns == clash.columns and same.columns == plain.columns, name
        kept = found.collect()
        assert {x[c] for x in kept for c in names} == {"own"}, name
        assert sorted(map(repr, (tuple(x)[:5] for x in kept))) == sorted(map(repr, map(tuple, same.collect()))), name
    no_counts = plain.drop("n_chars")
    assert corpus_pipeline.dedup_lines(spark, no_counts, data).columns == no_counts.columns
