"""Training samples and phrase prices of language ID where labels are rare, short or full of copies."""

from __future__ import annotations

import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pipeloom.llm import language, queries
from pipeloom.llm.common import ship_code

SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def real(spark, data):
    ship_code(spark)
    return [(d["doc_id"], d["text"], d["lang"]) for d in pq.read_table(f"{data}/documents.parquet").to_pylist()]


def plain_phrases(text, sample):
    """Greedy longest matches within stretches; a symbol outside the sample is a phrase of its own."""
    total = 0
    for lo in range(0, len(text), language.STRETCH):
        part, at = text[lo : lo + language.STRETCH], 0
        while at < len(part):
            n = 1
            if part[at : at + 1] in sample:
                while at + n < len(part) and part[at : at + n + 1] in sample:
                    n += 1
            at += n
            total += 1
    return total


def test_phrases_equal_a_plain_parse(monkeypatch):
    monkeypatch.setattr(language, "STRETCH", 50)
    monkeypatch.setattr(language, "LANES", 7)
    samples = [("a", bytes([1, 2, 3, 1, 2, 2, 3])), ("b", bytes([3, 3, 1, 4])), ("c", bytes([9]))]
    r = random.Random(2)
    texts = [np.array([r.randrange(1, 6) for _ in range(r.randrange(0, 700))], np.uint8) for _ in range(30)]
    assert language.Parser(samples).phrases(texts).tolist() == [[plain_phrases(bytes(t), s) for _, s in samples] for t in texts]


def test_predictions_equal_a_plain_parse(spark, data, real):
    """Every row of the query against substring search."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    samples = language.train(docs.where(~language.held_out()))
    texts = [(i, t) for i, t, _ in real] + [(-1, "??"), (-2, "zzq ~é日 x" * 30), (-3, ""), (-4, None), (-5, "x " * 3000)]
    frame = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(frame, samples).collect()}
    for i, t in texts:
        codes = language.normalise(t).tobytes() if t and any(map(str.isalpha, t)) else b""
        if not codes:
            assert found[i] == ("und", 0.0)
            continue
        counts = [plain_phrases(codes, sample) for _, sample in samples]
        best = min(range(len(counts)), key=lambda k: (counts[k], k))
        rest = min(c for k, c in enumerate(counts) if k != best)
        assert found[i] == (samples[best][0], pytest.approx(1 - counts[best] / rest, abs=1e-12)), i
    query = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in queries.op4_language_id(spark, data).collect()}
    assert query == {i: found[i] for i, _, _ in real}


def test_copies_dont_shrink_the_sample(spark):
    ids = spark.range(60_000).select(F.col("id").alias("doc_id"))
    word = lambda n: F.translate(F.md5(n.cast("string")), "0123456789", "ghijklmnop")
    # 8 languages of 5,000 rows that are copies of one text; 20,000 rows over 400 texts
    rows = ids.select("doc_id", F.when(F.col("doc_id") < 40_000, F.concat(F.lit("one text of language "), word(F.col("doc_id") % 8))).otherwise(word(F.col("doc_id") % 400)).alias("text"), F.when(F.col("doc_id") < 40_000, F.concat(F.lit("c"), (F.col("doc_id") % 8).cast("string"))).otherwise("many").alias("lang"))
    found = dict(language.train(rows))
    assert set(found) == {"many", *(f"c{k}" for k in range(8))}
    assert all(found[f"c{k}"].count(0) == 5 for k in range(8)), "five words: four separators and the end"
    assert found["many"].count(0) == language.TRAIN_ROWS


def test_the_sample_is_first_in_hash_order(spark):
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.translate(F.md5((F.col("id") % 10_000).cast("string")), "0123456789", "ghijklmnop").alias("text"), F.lit("en").alias("lang"))
    first = [r["text"] for r in rows.select("text").distinct().orderBy(F.xxhash64("text")).limit(language.TRAIN_ROWS).collect()]
    assert language.train(rows) == [("en", b"".join(language.normalise(t).tobytes() + b"\0" for t in first)[: language.TRAIN_BYTES])]


def test_passages_come_from_all_of_a_text(spark):
    r = random.Random(3)
    text = " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(3_000))
    (_, sample), = language.train(spark.createDataFrame([(1, text, "en")], SCHEMA), train_chars=100, train_rows=50)
    whole = language.normalise(text).tobytes()
    assert len(sample) > 4_000 and all(sample[k : k + 20] in whole or 0 in sample[k : k + 20] for k in range(0, len(sample), 97))
    places = [whole.find(sample[k : k + 30]) for k in range(0, len(sample) - 30, 101)]
    assert max(places) > 0.8 * len(whole)


def test_many_languages_share_the_bound(spark):
    word = lambda n: F.translate(F.md5(n.cast("string")), "0123456789", "ghijklmnop")
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(word(F.col("id") * 7 + k) for k in range(4))).alias("text"), F.concat(F.lit("l"), (F.col("id") % 400).cast("string")).alias("lang"))
    found = dict(language.train(rows))
    assert len(found) == 400 and {len(s) for s in found.values()} == {language.TRAIN_TOTAL // 400}


def test_labels_without_letters_have_no_sample(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "123", "zz"), (3, "-- 4", "zz"), (4, "", "yy")]
    assert [name for name, _ in language.train(spark.createDataFrame(rows, SCHEMA))] == ["en"]


@pytest.mark.parametrize("rare", [[("ok", 1)], [("123", 1)], [("The", 1)], [("ok then", 5_000)]])
def test_a_rare_label_wins_no_other_documents(spark, real, rare):
    rows = [*real, *((10**6 + k, text, "zz") for text, times in rare for k in range(times))]
    samples = language.train(spark.createDataFrame(rows, SCHEMA))
    found = {r["doc_id"]: r["lang_pred"] for r in language.identify(spark.createDataFrame(real, SCHEMA).select("doc_id", "text"), samples).collect()}
    assert sum(found[i] == lang for i, t, lang in real if t and any(map(str.isalpha, t))) >= 0.97 * len(real)


def test_an_empty_sample_never_wins(spark, real):
    samples = language.train(spark.createDataFrame(real, SCHEMA))
    docs = spark.createDataFrame(real, SCHEMA).select("doc_id", "text")
    with_empty = language.identify(docs, [*samples, ("zz", b""), ("zy", b"\0")]).collect()
    assert sorted(map(tuple, with_empty)) == sorted(map(tuple, language.identify(docs, samples).collect()))


def test_a_language_with_little_text_is_still_found(spark, real):
    samples = language.train(spark.createDataFrame(real, SCHEMA))
    short = [(name, sample[:1_000] if name == "de" else sample) for name, sample in samples]
    german = [(i, t) for i, t, lang in real if lang == "de" and t and any(map(str.isalpha, t))]
    found = language.identify(spark.createDataFrame(german, "doc_id long, text string"), short).collect()
    assert sum(r["lang_pred"] == "de" for r in found) >= 0.95 * len(german)
