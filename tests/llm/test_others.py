"""Language ID, vectors, packing, chat, mixing, licences and the pipeline."""

from __future__ import annotations

import math
import random
import re
import textwrap
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pipeloom.llm import chat, embedding_dedup, language, licences, mixing, neighbours, packing, queries, tokens, vectors
from pipeloom.llm.common import ship_code

from . import brute

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module", autouse=True)
def code(spark):
    ship_code(spark)


@pytest.fixture(scope="module")
def real(data):
    return pq.read_table(f"{data}/documents.parquet").to_pylist()


# licences


def test_licences(spark):
    mit = next(t for n, t in licences.KNOWN if n == "MIT")
    rows = [
        (1, mit), (2, "Copyright (c) 2020 A. Person\n\n" + mit.upper().replace(" ", "  ").replace("\"", "“")), (3, mit + " more"), (4, None), (5, ""), (6, "released under the mit licence"),
        (7, "  (C) someone\n© else\nLicensed under CC BY-NC 4.0"), (8, "Copyright x"), (9, "x" * 100_000),
    ]
    found = {r["doc_id"]: r["license_id"] for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: "MIT", 2: "MIT", 3: None, 4: None, 5: None, 6: "MIT", 7: "CC-BY-NC-4.0", 8: None, 9: None}
    assert licences.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    clash = licences.scan(spark.createDataFrame([(mit, "x", 1), (mit, "x", 1)], "text string, LICENSE_ID string, known_sha256 int"))
    assert clash.columns == ["text", "LICENSE_ID", "known_sha256", "canonical_sha256", "license_id_"] and [r[-1] for r in clash.collect()] == ["MIT", "MIT"]
    known = spark.createDataFrame([(t,) for _, t in licences.KNOWN], "text string").select(licences.canonical(F.col("text"))).collect()
    assert [r[0] for r in known] == [licences.canonical_text(t) for _, t in licences.KNOWN]


def wrapped(text, width):
    return "\n\n".join("\n".join(textwrap.wrap(part, width)) for part in re.split(r"\n[ \t]*\n", text))


@pytest.mark.parametrize("width", [40, 55, 60, 66, 72, 79, 90, 120])
def test_wrapping_changes_no_digest(width):
    for name, text in licences.KNOWN:
        parts = re.sub(r"\n+", "\n\n", text)
        again = "/* Copyright 1999-2021 The Authors */\nCopyright (c) 2020 A. Person <a@b.c>\n(C) 2001 B\nAll rights reserved.\n\n" + wrapped(parts, width)
        assert licences.canonical_text(again) == licences.canonical_text(text), (name, width)
        assert licences.canonical_text("\n".join("# " + line for line in again.split("\n"))) == licences.canonical_text(text), (name, width)


#: Where these texts are on the machine, by the names of their files.
COMMON = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}


def test_long_licences(spark):
    folder = Path("/usr/share/common-licenses")
    if not folder.exists():
        pytest.skip("no licence texts on this machine")
    rows = [(name, (folder / name).read_text()) for name in COMMON]
    apache = (folder / "Apache-2.0").read_text()
    rows += [("Apache-2.0", wrapped(apache, width)) for width in (50, 70, 100)] + [("Apache-2.0", re.sub(r"\bLICENSE\b", "LICENCE", apache.upper()))]
    found = licences.scan(spark.createDataFrame(rows, "file string, text string")).collect()
    assert [(r["file"], r["license_id"]) for r in found] == [(name, COMMON[name]) for name, _ in rows]


def test_evidence_queries_find_something(spark, data):
    found = queries.queries()["license_scan_known_texts"](spark, data).where("doc_id < 0").collect()
    forms = [name for name, _ in licences.KNOWN for _ in range(3)]
    assert {r["doc_id"]: r["license_id"] for r in found} == {-1 - k: name for k, name in enumerate(forms)}
    found = queries.queries()["chat_preferences_shared_prefix"](spark, data).collect()
    assert sum(r["prompt_turns"] for r in found) > len(found) > 0 and all(r["chosen_sha256"] != r["rejected_sha256"] for r in found)


# language


def test_suffix_automaton_accepts_substrings_only():
    r = random.Random(1)
    text = [r.randrange(3) for _ in range(60)]
    moves = language.suffix_automaton(text)

    def accepts(part):
        state = 0
        for c in part:
            if c not in moves[state]:
                return False
            state = moves[state][c]
        return True

    subs = {tuple(text[a:b]) for a in range(60) for b in range(a, min(60, a + 6) + 1)}
    for _ in range(500):
        part = tuple(r.randrange(3) for _ in range(r.randrange(6)))
        assert accepts(part) == (part in subs)


def test_language_accuracy_and_edges(spark, data):
    found = {r["doc_id"]: r for r in queries.op4_language_id(spark, data).collect()}
    truth = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{data}/documents.parquet").to_pylist()}
    held = [i for i in found if found[i]["held_out"]]
    assert held == [i for i in found if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(found[i]["lang_pred"] == truth[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found.values())
    docs = spark.read.parquet(f"{data}/documents.parquet")
    samples = language.train(docs.where(~language.held_out()))
    assert all(len(s) <= language.TRAIN_BYTES for _, s in samples)
    rows = [(1, None), (2, ""), (3, "12 34 !!"), (4, "the " * 40_000), (5, "日本語"), (6, "the the and of"), (6, "the the and of")]
    odd = sorted((r[0], r["lang_pred"]) for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string"), samples).collect())
    assert [x[1] == "und" for x in odd] == [True, True, True, False, False, False, False] and odd[3][1] == "en"
    clash = spark.createDataFrame([(1, "the and", "x", 1)], "doc_id long, text string, Lang_Pred string, score int")
    assert language.identify(clash, samples).columns == ["doc_id", "text", "Lang_Pred", "score", "lang_pred_", "score_"] and language.identify(clash, samples).count() == 1
    empty = spark.createDataFrame([], docs.schema)
    assert language.train(empty) == [] and language.identify(empty, samples).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs, []).collect()} == {"und"}


# vectors


def clusters(n=400, dim=48, seed=3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, dim))
    return [(k, (centres[k % 12] + r.normal(size=dim) * 0.28 * (k % 5 > 0)).astype(np.float32).tolist(), k % 3) for k in range(n)]


ODD_VECTORS = [(9001, None, 1), (9002, [0.0] * 48, 1), (9003, [math.nan] * 48, 1), (9004, [1.0] * 47 + [None], 1), (9005, [1.0] * 48, None), (9006, [1.0] * 7, 1), (9007, [2.0] * 7, 1), (9008, [], 1), (9009, [math.inf] * 48, 1), (9010, [1.0] * 7, 1)]
SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("block", [1024, 16])
def test_embedding_dedup(spark, block, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = clusters()
    union, links = brute.Union([r[0] for r in rows + ODD_VECTORS]), Counter()
    good = [(i, np.array(v, np.float64), lab) for i, v, lab in rows + ODD_VECTORS if lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    for k, (i, x, a) in enumerate(good):
        for j, y, b in good[:k]:
            if a == b and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                links[i] += 1
                links[j] += 1
                union.join(i, j)
    found = {r[0]: tuple(r[1:]) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows + ODD_VECTORS, SCHEMA).repartition(5)).collect()}
    assert found == {i: (links[i], union.root(i), i == union.root(i)) for i in union.up}
    assert sum(links.values()) > 1000


def test_embedding_dedup_edges(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, [1.0, 0.0], 1, "x"), (1, [1.0, 0.0], 1, "x"), (2, [1.0, 0.0], 1, "x"), (None, [1.0, 0.0], 1, "x")]
    found = embedding_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA + ", n_links string")).collect()
    assert sorted((r[0] or -1, *tuple(r)[1:]) for r in found if r[0]) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)] and len(found) == 4
    # rows of one id with different vectors are different vectors
    r = np.random.default_rng(1)
    a, b = r.normal(size=(2, 64))
    rows = [(1, a.tolist(), 1), (1, b.tolist(), 1), (2, (a * 2).tolist(), 1), (3, (b + 0.01).tolist(), 1), (4, (b * 3).tolist(), 1), (4, a.tolist(), 2)]
    found = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)).collect()
    assert sorted(tuple(r) for r in found) == [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (4, 0, 4, True), (4, 2, 1, False)]


def test_embedding_dedup_of_any_size_and_width(spark):
    schema = "vec_id long, embedding array<double>, label string"
    rows = [(1, [1e200, 2e200], "a"), (2, [1e-200, 2e-200], "a"), (3, [1.0, 2.0], "a"), (4, [5e-324, 1e-323], "a"), (5, [-1.0, -2.0], "a"), (6, [1.7e308, 1.7e308], "a")]
    found = {r[0]: tuple(r[1:]) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, schema)).collect()}
    assert found == {1: (4, 1, True), 2: (4, 1, False), 3: (4, 1, False), 4: (4, 1, False), 5: (0, 5, True), 6: (4, 1, False)}
    r = np.random.default_rng(2)
    base = r.normal(size=(6, 768))
    wide = [(k, (base[k % 6] + r.normal(size=768) * 0.1 * (k // 6)).tolist(), "w") for k in range(24)]
    union, links = brute.Union(range(24)), Counter()
    x = np.array([v for _, v, _ in wide])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.93, 1)), strict=True):
        links[int(i)] += 1
        links[int(j)] += 1
        union.join(int(i), int(j))
    found = {r[0]: (r[1], r[2]) for r in embedding_dedup.near_duplicates(spark.createDataFrame(wide, schema)).collect()}
    assert found == {k: (links[k], union.root(k)) for k in range(24)} and sum(links.values()) > 20


@pytest.mark.parametrize("n", [10**3, 10**5, 10**7, 10**9])
def test_pairs_at_the_threshold_share_a_bucket_at_every_size(n):
    """Hashes and tables follow from the number of vectors; what is found stays about the same."""
    hashes = embedding_dedup.hashes_for(n, 64)
    assert hashes in (embedding_dedup.LEAST_HASHES, embedding_dedup.MOST_HASHES) or n * (embedding_dedup.PROBES / 128) ** hashes <= embedding_dedup.BY_CHANCE
    r = np.random.default_rng(n)
    x, y = r.normal(size=(2, 400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y = 0.93 * x + math.sqrt(1 - 0.93**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    a, b = embedding_dedup.codes(x, hashes), embedding_dedup.codes(y, hashes)
    assert sum(len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b, strict=True)) >= 399


def test_hadamard_is_orthogonal():
    x = vectors.rotated(np.eye(16), 3)
    assert np.allclose(x @ x.T, np.eye(16))


@pytest.mark.parametrize("dim", [48, 200])
def test_nearest_neighbours(spark, dim, monkeypatch):
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 8)
    rows = clusters(dim=dim) + ODD_VECTORS
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = neighbours.nearest(df, F.col("id") % 20 == 0).collect()
    by = {}
    for q, rank, v, score in found:
        by.setdefault(q, []).append((rank, v, score))
    x = {i: np.array(v, np.float64) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    hits = 0
    asked = [i for i in x if i % 20 == 0]
    assert set(by) == set(asked)
    for q in asked:
        exact = sorted((np.sqrt(((x[i] - x[q]) ** 2).sum()), i) for i in x if i != q and len(x[i]) == len(x[q]))[:10]
        got = sorted(by[q])
        assert [r for r, _, _ in got] == list(range(1, len(got) + 1)) and len(got) == len(exact)
        assert [(s, v) for _, v, s in got] == sorted((s, v) for _, v, s in got)
        assert all(s == pytest.approx(np.sqrt(((x[v] - x[q]) ** 2).sum()), rel=1e-12) for _, v, s in got)
        hits += len({v for _, v, _ in got} & {i for _, i in exact})
    assert hits >= 0.97 * sum(map(len, by.values()))
    assert neighbours.nearest(spark.createDataFrame([], SCHEMA), F.col("id") % 20 == 0).count() == 0
    again = spark.createDataFrame([(0, [1.0, 2.0], 1)] * 3 + [(1, [1.0, 2.5], 1)] * 30 + [(2, [3.0, 4.0], 1), (2, [9.0, 9.0], 1), (0, [9.0, 8.0], 1)], SCHEMA).repartition(3)
    assert [tuple(r)[:3] for r in neighbours.nearest(again, F.col("id") == 0).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    few = spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [3.0, 4.0], 1)], SCHEMA)
    assert [tuple(r)[1:3] for r in neighbours.nearest(few, F.col("id") == 0).orderBy("rank").collect()] == [(1, 1), (2, 2)]


# packing


def test_tokens_equal_the_library():
    library, own = Tokenizer.from_file(VOCABULARY), tokens.Encoder(VOCABULARY)
    assert own.fast is not None
    r = random.Random(4)
    pool = [chr(c) for c in (*range(0x250), 0x2028, 0x3000, 0x4E00, 0x1F600, 0x661)] + ["'s", "'ll", "  ", "\n"] * 40
    texts = ["".join(r.choice(pool) for _ in range(r.randrange(50))) for _ in range(2000)] + ["", "a<|endoftext|>b", " " * 3000]
    for t in texts:
        assert np.frombuffer(own.ids(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("capacity", [1024, 60])
def test_packing(spark, real, capacity):
    docs = [(d["doc_id"], d["text"]) for d in real] + [(10**6, None), (10**6 + 1, ""), (7 * 10**6, "word " * 5000), (None, "x"), (1, real[1]["text"]), (1, real[1]["text"])]
    found = packing.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), VOCABULARY, capacity).collect()
    assert Counter(tuple(r)[:5] for r in found) == brute.pieces(docs, Tokenizer.from_file(VOCABULARY), capacity)
    assert brute.valid_packing([(r["length"], r["sequence_id"], r["offset"]) for r in found], capacity)
    used, least = len({r["sequence_id"] for r in found}), -(-sum(r["length"] for r in found) // capacity)
    assert used <= 1.03 * least + 2
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).count() == 0


def test_recipe_is_close_to_best_fit():
    r = random.Random(6)
    for _ in range(60):
        sizes = [r.randrange(1, 101) for _ in range(r.randrange(1, 300))]
        rows = packing.recipe(dict(Counter(sizes)), 100)
        placed = []
        for n, _, count, first, per, offset in rows:
            placed += [(n, first + i // per, offset + i % per * n) for i in range(count)]
        assert Counter(n for n, _, _ in placed) == Counter(sizes)
        assert brute.valid_packing(placed, 100)
        gaps: list[int] = []
        for n in sorted(sizes, reverse=True):
            fits = [k for k, g in enumerate(gaps) if g >= n]
            if fits:
                gaps[min(fits, key=gaps.__getitem__)] -= n
            else:
                gaps.append(100 - n)
        assert len({s for _, s, _ in placed}) <= len(gaps) + 1


def test_pieces_keep_their_ids(spark):
    df = spark.createDataFrame([(1, "one two three " * 30)], "doc_id long, text string")
    found = packing.pack(df, VOCABULARY, 16, keep_ids=True).orderBy("piece").collect()
    ids = [x for r in found for x in r["ids"]]
    assert ids == [*Tokenizer.from_file(VOCABULARY).encode("one two three " * 30).ids, 2]


# chat


def test_preferences(spark):
    turns = [
        (0, 0, "user", "q"), (0, 1, "assistant", "yes"), (0, 2, "user", "more"), (0, 3, "assistant", "A"), (1, 0, "user", "q"), (1, 1, "assistant", "no"), (2, 0, "user", "same"), (3, 0, "user", "same"),
        (4, 0, None, None), (7, 1, "assistant", "only"), (7, None, "system", "s"), (None, 0, "user", "lost"),
    ]
    found = {r["pair_id"]: r for r in chat.preference_pairs(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)).collect()}
    assert set(found) == {0, 1, 2, 3}
    r = found[0]
    assert (r["prompt_turns"], r["prompt"]) == (1, "<|user|>\nq<|end|>\n")
    assert r["chosen"] == "<|assistant|>\nyes<|end|>\n<|user|>\nmore<|end|>\n<|assistant|>\nA<|end|>\n" and r["rejected"] == "<|assistant|>\nno<|end|>\n"
    assert [r["chosen"][a:b] for a, b in r["chosen_mask"]] == ["yes<|end|>\n", "A<|end|>\n"] and [r["rejected"][a:b] for a, b in r["rejected_mask"]] == ["no<|end|>\n"]
    assert (found[1]["chosen"], found[1]["rejected"], found[1]["prompt_turns"]) == ("", "", 1)
    assert found[2]["chosen"] == "<|unknown|>\n<|end|>\n" and found[2]["rejected"] is None and found[2]["rejected_id"] is None
    assert found[3]["chosen"] is None and found[3]["rejected"].startswith("<|system|>")
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.preference_pairs(empty).count() == 0
    pairs = spark.createDataFrame([("p", 1, 0), ("z", 50, 51)], "pair_id string, chosen_id long, rejected_id long")
    named = {r["pair_id"]: r for r in chat.preference_pairs(spark.createDataFrame(turns, empty.schema), pairs).collect()}
    assert named["p"]["chosen"] == "<|assistant|>\nno<|end|>\n" and named["z"]["chosen"] is None and named["z"]["prompt"] == ""


# mixing


def test_mixing(spark, real):
    docs = [(d["doc_id"], d["source"], d["text"]) for d in real] + [(10**6, None, "abc" * 50), (10**6 + 1, "empty", None), (10**6 + 2, "empty", ""), (5, "src0", "x"), (5, "src0", "x")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    found = mixing.mix(df.repartition(3))
    assert Counter(r["doc_id"] for r in found.collect()) == brute.mix(docs)
    assert found.columns == ["doc_id", "source", "text", "rate", "copy"]
    assert mixing.mix(spark.createDataFrame([], df.schema)).count() == 0
    clash = mixing.mix(df.withColumns({"COPY": F.lit(1), "below": F.lit(2)}))
    assert clash.columns == ["doc_id", "source", "text", "COPY", "below", "rate", "copy_"] and clash.count() == found.count()


def test_mixing_hits_the_target(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 8, "a").otherwise("b").alias("source"), F.lit("x" * 10).alias("text"))
    n = {r["source"]: r["count"] for r in mixing.mix(docs, {"a": 1.0, "b": 3.0}).groupBy("source").count().collect()}
    assert n["a"] == pytest.approx(5000, rel=0.06) and n["b"] == pytest.approx(15_000, rel=0.03)
    rate = spark.createDataFrame([(0.3,), (16.0,)], "r double").select(mixing.cumulative(F.col("r"))).collect()
    assert all(r[0][-1] == pytest.approx(1, abs=1e-9) for r in rate) and max(len(r[0]) for r in rate) <= 106


def test_mixing_with_large_rates(spark, monkeypatch):
    """A rare source that is to be half of the corpus: rates in the hundreds, thousands and above what one array holds."""
    docs = [(k, "common", "x" * 1000) for k in range(3000)] + [(5000 + k, "rare", "y" * 250) for k in range(20)] + [(6000, "one", "z" * 50)]
    weights = {"common": 1.0, "rare": 1.0, "one": 1.0}
    found = Counter(r["doc_id"] for r in mixing.mix(spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(3), weights).select("doc_id", "copy").distinct().collect())
    mass = {"common": 3_000_000, "rare": 5_000, "one": 50}
    rate = {s: 333_333 / 999_999 * sum(mass.values()) / m for s, m in mass.items()} | {s: 1_000_000 / 3_000_000 * sum(mass.values()) / m for s, m in mass.items()}
    assert found == +Counter({i: brute.copies(rate[s], i) for i, s, _ in docs})
    assert found[6000] == pytest.approx(20_033, rel=0.03)
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 0)
    assert mixing.mix(spark.createDataFrame(docs, "doc_id long, source string, text string"), weights).count() == sum(found.values())


# pipeline


def test_pipeline_against_plain_stages(spark, data, real):
    docs = spark.createDataFrame([(d["doc_id"], d["text"], d["lang"], d["source"], d["n_chars"]) for d in real] + [(10**6, None, "en", "src0", 0), (10**6 + 1, "123", "en", "src1", 3)], spark.read.parquet(f"{data}/documents.parquet").schema)
    rows = [(d["doc_id"], d["source"], d["text"]) for d in real]
    frame = docs
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "ngram_jaccard", "mix_sources", "best_fit_packing"]

    def stage(name):
        found = stages[name](spark, frame, data)
        if name != "best_fit_packing":
            assert found.columns == docs.columns
        return spark.createDataFrame(found.collect(), found.schema)

    frame = stage("language_id")
    rows = [r for r in rows if any(map(str.isalpha, r[2] or ""))]
    assert sorted(r["doc_id"] for r in frame.collect()) == sorted(r[0] for r in rows)
    frame = stage("line_dedup")
    kept = {i: (t, gone) for i, t, _, gone in brute.line_dedup([(i, t) for i, _, t in rows])}
    rows = [(i, s, kept[i][0]) for i, s, _ in rows if kept[i][0] or not kept[i][1]]
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in frame.collect()} == {i: (t, len(t)) for i, _, t in rows}
    frame = stage("ngram_jaccard")
    comps = brute.near([(i, t) for i, _, t in rows])
    rows = [r for r in rows if comps[r[0]][1] == r[0]]
    assert sorted(r["doc_id"] for r in frame.collect()) == sorted(r[0] for r in rows)
    frame = stage("mix_sources")
    counts = brute.mix(rows)
    assert Counter(r["doc_id"] for r in frame.collect()) == counts
    found = stage("best_fit_packing").collect()
    texts = {i: t for i, _, t in rows}
    assert Counter(tuple(r)[:5] for r in found) == brute.pieces([(i, texts[i]) for i, n in counts.items() for _ in range(n)], Tokenizer.from_file(VOCABULARY))
    assert brute.valid_packing([(r["length"], r["sequence_id"], r["offset"]) for r in found])


def test_pipeline_runs(spark, data):
    assert corpus_pipeline.run(spark, data).count() > 0
