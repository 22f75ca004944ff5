"""Exact substring dedup by level-wise doubling (operator 1).

A window of words can only repeat if every window of half that length inside it
repeats.  The levels:

1. Half windows (10 words), of which one per full window is enough: its anchor, the
   half window with the smallest hash inside it, stands at the same place in every
   copy.  Full windows whose anchor is unique are dropped.
2. Full windows (20 words) of repeated anchors are judged as such, by 128 bits of
   hash under two keys.  These decide what is removed: every longer repeat consists
   of repeated full windows.
3. Windows that repeat are extended to twice their length as long as any survive: a
   window of 2n words is the pair of its two halves, so its class follows from the
   halves' classes alone and no text is read again.  They tell how long each
   document's repeats are.

Occurrences travel as packed lists (see ``blobs``): a batch of documents sends each
hash at most once, so a passage that stands in a third of all documents costs one
entry a batch.  The number of lists, and of groups of documents, follows from the
bytes of text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blobs, words
from .blobs import OCCURRENCE, PLACE, SHORT
from .common import dealt, discard, materialise, parts_of

MIN_WORDS = 20
#: Bytes of text that are hashed at a time, and occurrences that are packed at a time.
BATCH, PACKED = 4_000_000, 2_000_000
#: The least id; texts with a null id are known by it and as many bits of their hash.
NULL_ID, UNNAMED = -(2**63), 2**62 - 1
#: Kinds of moved rows: occurrences to judge by range of hashes, places known to repeat by group of documents, longest levels by group.
JUDGED, KNOWN, LONGEST = 0, 1, 2
MOVED = "kind int, key long, data binary"
LEVEL = (("doc", np.int64), ("size", np.int64))


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``BATCH`` bytes of text each."""
    lengths = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(batch):
        hi = max(lo + 1, int(np.searchsorted(lengths, (lengths[lo - 1] if lo else 0) + BATCH, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi
    blobs.tidy()


def anchors(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of all full windows, place of each one's anchor, hashes of half windows)."""
    half = size // 2
    grams = words.ngrams(hashes, half, 1)
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), grams
    least, at = grams[:n].copy(), np.zeros(n, np.int64)
    for k in range(1, size - half + 1):
        smaller = grams[k : k + n] < least
        least[smaller] = grams[k : k + n][smaller]
        at[smaller] = k
    inside = np.zeros(n, bool)
    lengths = np.diff(first)
    ends = np.repeat(first[1:], lengths)[:n]
    np.less_equal(np.arange(n) + size, ends, out=inside)
    starts = np.flatnonzero(inside)
    return starts, starts + at[starts], grams


def rows(kinds: list[int], keys: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(keys, pa.int64()), pa.array(data, pa.binary())], names=["kind", "key", "data"])


def table_of(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return rows(*map(list, zip(*found, strict=True))) if found else rows([], [], [])


def occurrences(hashes: dict, at: np.ndarray, ids: np.ndarray, first: np.ndarray) -> dict:
    """The windows that start at words ``at``, by document and place there."""
    owner = np.searchsorted(first, at, side="right") - 1
    return {k: h[at] for k, h in hashes.items()} | {"doc": ids[owner], "pos": (at - first[owner]).astype(np.int32), "flag": np.zeros(len(at), np.uint8)}


def sendable(found: dict, buckets: int, groups: int) -> list[tuple[int, int, bytes]]:
    """Rows for one batch's occurrences: one of each hash to judge, flagged if it repeats here, and the others, which are known to occur earlier."""
    found, new = blobs.by_hash(found)
    starts = np.flatnonzero(new)
    sent = blobs.take(found, starts)
    sent["flag"] = (np.diff(starts, append=len(new)) > 1).astype(np.uint8)
    known = blobs.take(found, np.flatnonzero(~new))
    known["flag"][:] = 1
    out = [(JUDGED, *x) for x in blobs.split(sent, (sent["h"] >> np.uint64(20)).astype(np.int64) % buckets, OCCURRENCE if "g" in found else SHORT)]
    return out + [(KNOWN, *x) for x in blobs.split(known, blobs.group_of(known["doc"], groups), PLACE, ("doc", "pos"))]


def sent(parts: Iterable[dict], buckets: int, groups: int) -> Iterator[pa.RecordBatch]:
    """:func:`sendable` rows of occurrences that are gathered until they are worth packing."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part["h"])
        if size >= PACKED:
            yield table_of(sendable(blobs.concat(held), buckets, groups))
            held, size = [], 0
    if size:
        yield table_of(sendable(blobs.concat(held), buckets, groups))
    blobs.tidy()


def live_words(ids: np.ndarray, first: np.ndarray, docs: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """True at the words of a batch where a listed place of its documents lies."""
    live = np.zeros(n + 1, bool)
    for row, (a, b) in enumerate(zip(np.searchsorted(docs, ids, "left"), np.searchsorted(docs, ids, "right"), strict=True)):
        if b > a:
            live[np.minimum(first[row] + places[a:b], n)] = True
    return live


def doc_ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def repeats(moved: DataFrame, buckets: int, groups: int, kinds: tuple) -> DataFrame:
    """Judge the occurrences of each range of hashes together; other rows pass through.  Result: moved rows by group of documents.

    A class repeats if it stands at two places (rows that repeat a whole document
    are one place); its places after the first are flagged.
    """

    def judged(group: pa.Table) -> pa.Table:
        if group.column("kind")[0].as_py() != JUDGED:
            return group
        found, new = blobs.by_hash(blobs.unpack(group.column("data").to_pylist(), kinds))
        if not len(new):
            return group.slice(0, 0)
        at = np.cumsum(new) - 1
        many = np.bincount(at) + np.bincount(at, found["flag"])
        found["flag"] = (~new).astype(np.uint8)
        found = blobs.take(found, np.flatnonzero(many[at] > 1))
        out = [(KNOWN, *x) for x in blobs.split(found, blobs.group_of(found["doc"], groups), PLACE, ("doc", "pos"))]
        del found
        blobs.tidy()
        return pa.Table.from_batches([table_of(out)])

    return dealt(moved, buckets, "kind", "key").groupBy("kind", "key").applyInArrow(judged, MOVED)


def places(moved: pa.Table, kind: tuple = PLACE, of: int = KNOWN) -> dict:
    """The packed columns in a group's rows of one kind, sorted by document and place."""
    data = [d for k, d in zip(moved.column("kind").to_pylist(), moved.column("data").to_pylist(), strict=True) if k == of]
    found = blobs.unpack(data, kind)
    return blobs.take(found, np.lexsort((found[kind[1][0]], found["doc"])))


class Levels:
    """The levels of one corpus: documents dealt into groups, and how to judge a level."""

    def __init__(self, docs: DataFrame, min_words: int, id_col: str, text_col: str):
        if min_words < 2:
            raise ValueError("min_words must be at least 2")
        self.spark, self.size = docs.sparkSession, min_words
        given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
        # texts without an id are documents of their own, dealt like any others
        unnamed = F.xxhash64("body").bitwiseAND(F.lit(UNNAMED)).bitwiseOR(F.lit(NULL_ID))
        source = given.select(F.coalesce("id", unnamed).alias("doc"), "body", "id")
        self.buckets = parts_of(self.spark, source.agg(F.sum(F.octet_length("body"))).first()[0])
        self.groups = self.buckets
        self.source = source
        self.grouped = source.withColumn("key", group_column(F.col("doc"), self.groups))

    def with_places(self, table: DataFrame, function, schema: str) -> DataFrame:
        """``function(texts, moved rows)`` for each group of documents."""
        texts, moved = dealt(self.grouped, self.groups, "key"), dealt(table, self.groups, "key")
        return texts.groupBy("key").cogroup(moved.groupBy("key")).applyInArrow(function, schema)

    def judge(self, moved: DataFrame, tag: str, kinds: tuple = SHORT) -> DataFrame:
        return materialise(repeats(moved, self.buckets, self.groups, kinds), tag)

    def half(self) -> DataFrame:
        """Anchors that repeat."""
        size, buckets, groups = self.size, self.buckets, self.groups

        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for batch in batches:
                for part in slices(batch, 1):
                    hashes, first = words.words(part.column(1))
                    _, anchor, grams = anchors(hashes, first, size)
                    yield occurrences({"h": grams}, np.unique(anchor), doc_ids(part.column(0)), first)

        def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from sent(windows(batches), buckets, groups)

        return self.judge(self.source.mapInArrow(moved, MOVED), "anchors")

    def full(self, alive: DataFrame) -> DataFrame:
        """Full windows that repeat, of anchors that do."""
        size, buckets, groups = self.size, self.buckets, self.groups

        def windows(texts: pa.Table, found: dict) -> Iterator[dict]:
            for batch in texts.combine_chunks().to_batches():
                for part in slices(batch, 1):
                    hashes, first = words.words(part.column(1), keys=2)
                    ids = doc_ids(part.column(0))
                    live = live_words(ids, first, found["doc"], found["pos"].astype(np.int64), hashes.shape[1])
                    starts, anchor, _ = anchors(hashes[0], first, size)
                    yield occurrences({"h": words.ngrams(hashes[0], size, 2), "g": words.ngrams(hashes[1], size, 3)}, starts[live[anchor]], ids, first)

        def moved(texts: pa.Table, table: pa.Table) -> pa.Table:
            found = places(table)
            texts = texts.filter(pa.array(np.isin(doc_ids(texts.column("doc").combine_chunks()), found["doc"])))
            return pa.Table.from_batches([*sent(windows(texts, found), buckets, groups), rows([], [], [])])

        return self.judge(self.with_places(alive, moved, MOVED), "windows", OCCURRENCE)

    def doubled(self, alive: DataFrame, size: int) -> DataFrame:
        """Windows of ``2 * size`` words that repeat, of those of ``size`` that do; with them the documents that had the latter."""
        buckets, groups = self.buckets, self.groups

        def moved(table: pa.Table) -> pa.Table:
            found = places(table)
            docs, owner = np.unique(found["doc"], return_inverse=True)
            at = (owner.astype(np.int64) << 32) + found["pos"]
            other = np.minimum(np.searchsorted(at, at + size), len(at) - 1)
            both = np.flatnonzero(at[other] == at + size)
            pair = words.ngrams(np.stack([found["h"][both], found["h"][other[both]]], 1).reshape(-1), 2, 4)[::2]
            longer = {"h": pair, "doc": found["doc"][both], "pos": found["pos"][both], "flag": np.zeros(len(both), np.uint8)}
            out = sendable(longer, buckets, groups)
            out += [(LONGEST, *x) for x in blobs.split({"doc": docs, "size": np.full(len(docs), size)}, blobs.group_of(docs, groups), LEVEL)]
            del found, longer
            blobs.tidy()
            return pa.Table.from_batches([table_of(out)])

        per_group = dealt(alive.where(F.col("kind") == KNOWN), groups, "key").groupBy("key")
        return self.judge(per_group.applyInArrow(moved, MOVED), "windows")

    def all(self) -> tuple[DataFrame, DataFrame]:
        """(full windows that repeat; the longest levels of documents): goes on until no window survives."""
        anchors_alive = self.half()
        first = alive = self.full(anchors_alive)
        discard(anchors_alive)
        size, longest = self.size, first.limit(0)
        while alive.where(F.col("kind") == KNOWN).limit(1).count():
            before, alive = alive, self.doubled(alive, size)
            if before is not first:
                discard(before)
            longest = longest.union(materialise(alive.where(F.col("kind") == LONGEST), "levels"))
            size *= 2
        return first, longest


def dedup_substrings(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Per document: id, n_words, n_removed, kept_sha256, longest_repeat and, with ``with_text``, kept_text.

    A word goes if a window of ``min_words`` words covers it whose words also start
    earlier (smaller id, or earlier in the same document); windows are judged on
    the input.  Kept words are joined by one space.  ``longest_repeat`` is the
    greatest min_words * 2**k words at which a window of the document stands at two
    places of the corpus, 0 if none does.  Ids are integers.  Null text has no
    words, as has empty text; rows with the same id and text are the same places
    (neither removes the other); rows with the same id and different texts are one
    document with the windows of all, and a word goes if it stands at a place that is
    removed in any of them; rows with null ids and different texts are different
    documents, in the order of their texts' hashes, before all ids from -2**62 on;
    other columns are not read; an empty table gives no rows.
    """
    levels = Levels(docs, min_words, id_col, text_col)
    windows, longest = levels.all()
    text_field = ", kept_text string" if with_text else ""

    def cut(texts: pa.Table, moved: pa.Table) -> pa.Table:
        found = places(moved)
        found = blobs.take(found, np.flatnonzero(found["flag"]))
        level = places(moved, LEVEL, LONGEST)
        n_words, n_removed, digests, kept_texts = [], [], [], []
        ids = doc_ids(texts.column("doc").combine_chunks())
        lo, hi = np.searchsorted(found["doc"], ids, "left"), np.searchsorted(found["doc"], ids, "right")
        last = np.searchsorted(level["doc"], ids, "right")
        best = [int(level["size"][k - 1]) if k and level["doc"][k - 1] == i else 0 for k, i in zip(last.tolist(), ids.tolist(), strict=True)]
        for row, text in enumerate(texts.column("body")):
            split = (text.as_py() or "").encode().split()
            removed = 0
            n_words.append(len(split))
            if hi[row] > lo[row]:
                starts = found["pos"][lo[row] : hi[row]].astype(np.int64)
                starts = starts[starts + min_words <= len(split)]
                edge = np.zeros(len(split) + 1, np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + min_words, -1)
                stays = np.cumsum(edge[:-1]) == 0
                removed = len(split) - int(stays.sum())
                split = list(compress(split, stays.tolist()))
            kept = b" ".join(split)
            n_removed.append(removed)
            digests.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                kept_texts.append(kept.decode())
        columns = [texts.column("id").combine_chunks(), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(best, pa.int64())]
        names = [id_col, "n_words", "n_removed", "kept_sha256", "longest_repeat"]
        if with_text:
            columns.append(pa.array(kept_texts, pa.string()))
            names.append("kept_text")
        return pa.Table.from_arrays(columns, names=names)

    return levels.with_places(windows.union(longest), cut, f"`{id_col}` long, n_words long, n_removed long, kept_sha256 string, longest_repeat long{text_field}")


def group_column(doc: Column, groups: int) -> Column:
    """The group of a document; equals :func:`blobs.group_of`."""
    x = F.coalesce(doc, F.lit(NULL_ID))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 32)).bitwiseAND(F.lit(0x7FFFFFFF))
    return F.shiftright(F.lit(0x9E3779B1).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)) * x % F.lit(2**32), 7) % groups
