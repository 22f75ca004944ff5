"""Substring, line and near-duplicate operators against plain versions, and their edge cases."""

from __future__ import annotations

import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pipeloom.llm import blobs, lines, queries, shingles, substrings
from pipeloom.llm import words as W
from pipeloom.llm.common import connected_components, ship_code

from . import brute

DOCS = "doc_id long, text string"
ODD = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, " \t\n"), (-5, "a b " * 100), (10**6 + 3, "é\x0bü " * 60), (10**6 + 4, "w" * 50_000), (10**6 + 5, " ".join(map(str, range(30_000))))]


@pytest.fixture(scope="module", autouse=True)
def code(spark):
    ship_code(spark)


@pytest.fixture(scope="module")
def real(data):
    t = pq.read_table(f"{data}/documents.parquet")
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))


def copies(seed=1):
    """Near copies of one text at many distances, and short texts."""
    r = random.Random(seed)
    base = [str(r.randrange(10**6)) for _ in range(200)]
    out = []
    for k in range(40):
        w = list(base)
        for _ in range(r.randrange(0, 16)):
            w[r.randrange(len(w))] = str(r.randrange(10**6))
        out.append((10**5 + k, " ".join(w)))
    for k in range(40):
        n = r.randrange(1, 30)
        w = base[:n]
        if r.random() < 0.6:
            w[r.randrange(n)] = "x"
        out.append((2 * 10**5 + k, " ".join(w).upper()))
    return out


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\t\n\x0b☃", max_size=40)), max_size=8))
@settings(max_examples=150, deadline=None)
def test_words_equal_the_pattern(texts):
    hashes, first = W.words(pa.array(texts, pa.string()))
    known = {}
    for k, t in enumerate(texts):
        found = brute.words(t)
        assert first[k + 1] - first[k] == len(found)
        for w, h in zip(found, hashes[first[k] : first[k + 1]].tolist(), strict=True):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def test_words_across_blocks(monkeypatch):
    monkeypatch.setattr(W, "BLOCK", 7)
    texts = ["abc defghijklmnopq rs", "", "tuv", None, "x" * 40, "a b c d e f g h"]
    small, first = W.words(pa.array(texts))
    monkeypatch.setattr(W, "BLOCK", 1 << 20)
    whole, again = W.words(pa.array(texts))
    assert (small == whole).all() and (first == again).all()


def test_blobs_round_trip():
    columns = {"h": np.array([3, 2**64 - 1], np.uint64), "doc": np.array([-5, 7]), "pos": np.array([1, 2], np.int32), "flag": np.array([0, 1], np.uint8)}
    found = blobs.unpack([blobs.pack(columns, blobs.SHORT)] * 2, blobs.SHORT)
    assert all((found[k] == np.tile(v, 2)).all() for k, v in columns.items())
    assert blobs.unpack([], blobs.OCCURRENCE)["h"].size == 0


def test_groups_agree(spark):
    ids = [0, 1, -1, 2**40, -(2**63), 2**63 - 1, 12345]
    found = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "doc long").select(substrings.group_column(F.col("doc"), 13)).collect()]
    assert found == blobs.group_of(np.array(ids), 13).tolist()


def test_components(spark):
    r = random.Random(2)
    edges = [(k, k + 1) for k in range(300)] + [(1000 + r.randrange(80), 1000 + r.randrange(80)) for _ in range(60)] + [(5000, k) for k in range(5001, 5200)]
    union = brute.Union({x for e in edges for x in e})
    for e in edges:
        union.join(*e)
    found = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert found == {n: union.root(n) for n in union.up}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def doubles(docs, size):
    """{id: greatest size * 2**k at which a window of the document stands twice, or 0}."""
    split, found = {i: brute.words(t) for i, t in docs}, dict.fromkeys([i for i, _ in docs], 0)
    while True:
        times = Counter(tuple(w[s : s + size]) for w in split.values() for s in range(len(w) - size + 1))
        level = {i for i, w in split.items() if any(times[tuple(w[s : s + size])] > 1 for s in range(len(w) - size + 1))}
        if not level:
            return found
        found |= dict.fromkeys(level, size)
        size *= 2


@pytest.mark.parametrize("size", [4, 20])
def test_substrings(spark, real, size, monkeypatch):
    monkeypatch.setattr(substrings, "PACKED", 5_000)
    runs = [(5000, " ".join(f"r{k}" for k in range(90))), (5001, "x " + " ".join(f"r{k}" for k in range(5, 88))), (5002, " ".join(["same"] * 41))]
    docs = real[:120] + copies() + ODD + runs
    df = spark.createDataFrame(docs, DOCS).repartition(5)
    found = substrings.dedup_substrings(df, size).collect()
    assert {r[0]: tuple(r[1:4]) for r in found} == brute.substrings(docs, size)
    assert all(len(r["kept_text"].split()) == r["n_words"] - r["n_removed"] for r in found)
    longest = {r[0]: r["longest_repeat"] for r in found}
    assert longest == doubles(docs, size) and (longest[5001], longest[5002]) == ((80, 40) if size == 20 else (64, 32))


def thue_morse(steps):
    a, b = "a", "b"
    for _ in range(steps):
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("steps", [4, 6, 10])
def test_words_that_a_polynomial_confuses(spark, steps):
    a, b = thue_morse(steps)
    rest = " ".join(f"w{k}" for k in range(19))
    docs = spark.createDataFrame([(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, a), (4, b)], DOCS)
    assert sorted((r[0], r[2]) for r in substrings.dedup_substrings(docs).collect()) == [(1, 0), (2, 0), (3, 0), (4, 0)]
    parts = {r[0]: r[2] for r in shingles.near_duplicates(docs).collect()}
    assert parts[3] == 3 and parts[4] == 4


@given(st.lists(st.text(alphabet="abAB\x00é", min_size=1, max_size=140), min_size=2, max_size=20, unique=True))
@settings(max_examples=100, deadline=None)
def test_word_hashes_differ(found):
    hashes, first = W.words(pa.array([" ".join(found)]), keys=2)
    assert hashes.shape == (2, len(found)) and all(len(set(h.tolist())) == len(found) for h in hashes)


def test_substrings_edges(spark):
    assert substrings.dedup_substrings(spark.createDataFrame([], DOCS)).count() == 0
    text = " ".join(f"w{k}" for k in range(25))
    rows = [(1, text, 9), (1, text, 9), (None, text, 9), (2, text, 9)]
    found = substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string, n_words long")).collect()
    assert sorted((str(r[0]), r[2]) for r in found) == [("1", 25), ("1", 25), ("2", 25), ("None", 0)]
    # one row, however often repeated, is one place; of one id's different texts, what repeats elsewhere later goes
    found = substrings.dedup_substrings(spark.createDataFrame([(1, text), (1, text), (2, "other " + text), (2, text[:40])], DOCS).repartition(3)).collect()
    assert sorted((r[0], r[1], r[2], r["longest_repeat"]) for r in found) == [(1, 25, 0, 20), (1, 25, 0, 20), (2, 13, 0, 20), (2, 26, 25, 20)]
    found = substrings.dedup_substrings(spark.createDataFrame([(1, text), (1, text)], DOCS).repartition(2)).collect()
    assert [(r[2], r["longest_repeat"]) for r in found] == [(0, 0), (0, 0)]


def test_substrings_of_texts_without_ids(spark):
    """Rows with null ids are documents of their own: what goes from one leaves the others' words alone."""
    text = lambda c, n: " ".join(f"{c}{k}" for k in range(n))
    rows = [(None, text(c, 60)) for c in "abcdef"] + [(None, f"{text('p', 5)} {text('z', 30)} {text('q', 5)}"), (None, f"{text('z', 30)} {text('r', 9)}"), (0, text("a", 60)), (-3, text("b", 20)), (4, text("b", 20)), (None, None), (None, "")]
    found = substrings.dedup_substrings(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    named = {r[0]: (r[1], r[2]) for r in found if r[0] is not None}
    assert named == {0: (60, 60), -3: (20, 20), 4: (20, 20)}
    unnamed = sorted((r[1], r[2], r["longest_repeat"]) for r in found if r[0] is None)
    one = [(39, 0, 20), (40, 30, 20)] if (39, 0, 20) in unnamed else [(39, 30, 20), (40, 0, 20)]  # the passage stays in one of the two
    assert unnamed == sorted([(0, 0, 0)] * 2 + one + [(60, 0, 40)] + [(60, 0, 20)] + [(60, 0, 0)] * 4)


def test_substrings_with_a_third_of_the_ids_null(spark, real):
    """The rows with null ids are dealt into many groups, and the result is that of the plain version with their places in the order."""
    docs = [(None if k % 3 == 0 else i, t) for k, (i, t) in enumerate(real[:90])]
    df = spark.createDataFrame(docs, DOCS)
    levels = substrings.Levels(df, 20, "doc_id", "text")
    names = [r[0] for r in levels.source.collect()]
    assert len(set(names)) > 80 and len({substrings.blobs.group_of(np.array([n]), 64)[0] for n in names if n < -(2**62)}) > 10
    texts = {}
    for name, (_, t) in zip(names, docs, strict=True):
        texts.setdefault(name, t)
    plain = brute.substrings(list(texts.items()), 20)
    expected = sorted((str(i), *plain[n][:3]) for n, (i, _) in zip(names, docs, strict=True))
    assert sorted((str(r[0]), r[1], r[2], r[3]) for r in substrings.dedup_substrings(df).collect()) == expected


@pytest.mark.parametrize("block", [512, 8])
def test_near_duplicates(spark, real, block, monkeypatch):
    monkeypatch.setattr(shingles, "BLOCK", block)
    monkeypatch.setattr(shingles, "WHOLE_BLOCK", block)
    docs = real[:120] + copies() + ODD
    found = shingles.near_duplicates(spark.createDataFrame(docs, DOCS).repartition(5)).collect()
    assert {r[0]: tuple(r[1:3]) for r in found} == brute.near(docs)


def test_near_duplicates_edges(spark):
    assert shingles.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, "a b c d e f", 0), (1, "a b c d e f", 0), (2, "A B C d e f", 0), (None, "a b c d e f", 0), (3, None, 0)]
    found = shingles.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id int")).collect()
    assert sorted((r[0] or -1, r[1], r[2]) for r in found) == [(-1, 2, None), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]
    # rows of one id with different texts are one document
    text = lambda c: " ".join(f"{c}{k}" for k in range(40))
    rows = [(7, text("a")), (7, text("b")), (5, text("a") + " z"), (6, "y " + text("b")), (8, text("c")), (9, text("b"))]
    found = shingles.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert sorted((r[0], r[1], r[2]) for r in found) == [(5, 37, 5), (6, 37, 5), (7, 36, 5), (7, 36, 5), (8, 36, 8), (9, 36, 5)]


def test_keys_are_certain():
    """Linked sets share as many keys as is claimed, at the threshold and for all pairs of sizes."""
    for percent in (50, 75, 90):
        for n in range(1, 120):
            for m in range(n, 200):
                least = -(-percent * (n + m) // (100 + percent))
                if least <= n:
                    # worst case: what only one of them has sorts before what both have
                    shared = min(shingles.key_count(n, percent) - (n - least), shingles.key_count(m, percent) - (m - least), least)
                    assert shared >= max(shingles.least_shared(n, percent), shingles.least_shared(m, percent)), (percent, n, m)


def test_a_hot_key_among_many_sets(spark, monkeypatch):
    """One passage in every document: groups larger than a block, near copies and strangers of many sizes."""
    monkeypatch.setattr(shingles, "BLOCK", 16)
    monkeypatch.setattr(shingles, "WHOLE_BLOCK", 16)
    r = random.Random(9)
    passage = [f"p{k}" for k in range(30)]
    docs = []
    for k in range(60):
        docs.append((k, " ".join(passage + [f"own{k}x{j}" for j in range(r.randrange(0, 40))])))
    base = [f"c{k}" for k in range(25)]
    for k in range(60):
        w = passage + base
        w[r.randrange(len(w))] = f"e{k}"
        docs.append((1000 + k, " ".join(w)))
    found = shingles.near_duplicates(spark.createDataFrame(docs, DOCS).repartition(5)).collect()
    assert {r[0]: tuple(r[1:3]) for r in found} == brute.near(docs)


def test_tree_prunes_no_link():
    r = random.Random(5)
    base = np.unique(np.array([r.getrandbits(64) for _ in range(120)], np.uint64))
    family = [base]
    for _ in range(60):
        own = base.copy()
        own[r.sample(range(len(own)), r.randrange(0, 40))] = [r.getrandbits(64) for _ in range(1)][0]
        family.append(np.unique(own))
    data = np.empty(len(family), object)
    data[:] = [x.view(np.uint8) for x in family]
    part = {"doc": np.arange(len(family)), "comp": np.arange(len(family)), "n": np.array([len(x) for x in family]), "data": data}
    x, y = shingles.join_group(part, None, 75, True)
    union = brute.Union(range(len(family)))
    for a, b in zip(x.tolist(), y.tolist(), strict=True):
        union.join(a, b)
    model = brute.Union(range(len(family)))
    for a in range(len(family)):
        for b in range(a):
            common = len(np.intersect1d(family[a], family[b]))
            if 100 * common >= 75 * (len(family[a]) + len(family[b]) - common):
                model.join(a, b)
    assert [union.root(k) for k in range(len(family))] == [model.root(k) for k in range(len(family))]


def test_line_dedup(spark, real):
    shared = "\n".join(f"line {k} of a shared passage" for k in range(12))
    docs = real + [(10**6 + k, f"own {k}\n" * (k % 3) + shared + f"\nend {k}") for k in range(10)] + [(10**7, None), (10**7 + 1, ""), (10**7 + 2, "\n\n\n"), (10**7 + 3, shared), (10**7 + 3, shared), (None, shared)]
    found = lines.dedup_lines(spark.createDataFrame(docs, DOCS).repartition(6))
    expected = brute.line_dedup([d for d in docs if d[0] is not None])
    rows = [tuple(r) for r in found.where("doc_id is not null").collect()]
    # the row without an id comes before all others, so its chunks are the first ones
    without = lines.dedup_lines(spark.createDataFrame([d for d in docs if d[0] is not None], DOCS))
    assert sorted(map(repr, (tuple(r) for r in without.collect()))) == sorted(map(repr, expected))
    assert len(rows) == len(expected)


def test_planted_lines(spark):
    """All of an exact copy goes; of a passage inside other text all but its two ends, wherever it stands."""
    r = random.Random(11)
    new = lambda n: [" ".join(str(r.randrange(10**6)) for _ in range(8)) for _ in range(n)]
    texts = [new(n) for n in range(2, 12)]
    passage = new(20)
    docs = [(k, "\n".join(t)) for k, t in enumerate(texts)] + [(100 + k, "\n".join(t)) for k, t in enumerate(texts)]
    docs += [(200, "\n".join(passage))] + [(201 + k, "\n".join(new(k % 5) + passage + new(1 + k % 4))) for k in range(12)]
    found = {x["doc_id"]: x for x in lines.dedup_lines(spark.createDataFrame(docs, DOCS)).collect()}
    assert all(found[k]["n_removed_lines"] == 0 for k in range(10)) and all(found[100 + k]["text"] == "" for k in range(10))
    gone = [found[201 + k]["n_removed_lines"] for k in range(12)]
    assert min(gone) >= 12 and sum(gone) >= 0.75 * 20 * 12
    chunked = [lines_ for _, lines_ in brute.line_chunks("\n".join(new(500)))]
    assert min(map(len, chunked)) >= 2 and 2.5 < 500 / len(chunked) < 3.5


@pytest.mark.parametrize("name", ["op6_line_dedup", "op10_mix_sources"])
def test_queries_with_clashing_columns(spark, data, tmp_path, name):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    new = ["n_lines", "n_removed_lines", "copy", "rate", "gone", "text_key", "below", "mixed_source", "lang_pred", "score"]
    docs.withColumns({c: F.lit("own") for c in new}).write.parquet(f"{tmp_path}/documents.parquet")
    found, expected = (sorted(map(repr, queries.queries()[name](spark, str(d)).collect())) for d in (tmp_path, data))
    assert found == expected


def test_line_dedup_edges(spark):
    assert lines.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0
    clash = spark.createDataFrame([(1, "a\nb\nc", 7, 8)], "doc_id long, text string, N_LINES int, gone int")
    found = lines.dedup_lines(clash)
    assert found.columns == ["doc_id", "text", "N_LINES", "gone", "n_lines_", "n_removed_lines"] and tuple(found.first()) == (1, "a\nb\nc", 7, 8, 3, 0)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, data, name):
    duck = duckdb.connect()
    for t in ("documents", "conversations"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    df = queries.queries()[name](spark, data)
    found = duck.sql(queries.oracle_sql()[name])
    place = [list(found.columns).index(c) for c in df.columns]
    assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(repr(tuple(r[k] for k in place)) for r in found.fetchall())
