"""N-gram Jaccard join and near-duplicate components by signature trees (operator 3).

Documents are sets of word shingles; two link when their Jaccard similarity is at
least ``percent`` in a hundred.  The steps, each over all documents:

1. Equal sets collapse to their smallest document (a 128-bit digest, pre-aggregated).
2. Each set's smallest shingle hashes are its keys, so many that two linked sets are
   certain to share ``least_shared`` of them, whatever their sizes (see ``key_count``).
   Sets with fewer keys that any other set has can't link and end here.
3. The sets that share a key form a group.  In a group a *signature tree* is built:
   its leaves are sets, its nodes hold OR-combined bitmaps and size ranges, and a
   dual traversal drops every pair of nodes whose greatest possible overlap is too
   small for a link.  A set takes part in the groups of its rarest keys only, as
   many as a link must share one of; keys with the same smallest document are one
   group; a large group is dealt into blocks, and pairs of blocks are joined as
   separate tasks.
4. Pairs that come through are compared exactly, shingle by shingle, in two rounds.
   The first takes a spanning forest of each group, most similar pairs first; its
   links give components.  The second judges *all* remaining pairs between
   different components where their sets meet, and reports links that span them.
   There a large group is split by component and by range of sizes first, so that
   sets which are linked already, or too unlike in size, never meet: no link between
   components is lost, and thousands of near copies never become millions of rows.

Shingles are compared by 64-bit hashes that no structure of words makes collide (see
``words``), and only between sets that meet; equal sets by 128 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs, words
from .common import connected_components, dealt, discard, materialise, parts_of
from .substrings import MOVED, doc_ids, group_column, slices, table_of

SHINGLE, PERCENT = 5, 75
#: Of the shingles that a link must have in common, this fraction is looked for among the keys.
SHARE = 1 / 8
#: Largest block of a group that meets another one in a task, by bitmaps and by sets.
BLOCK, WHOLE_BLOCK = 512, 512
FANOUT = 8
#: Bits a shingle of the bitmaps that travel, and of those made where the sets are at hand.
NARROW, WIDE = 4, 16
#: Columns of a 0/1 matrix, and pairs of nodes, that are at hand at a time; keys that are packed at a time.
COLUMNS, PAIRS, PACKED = 2048, 32_768, 1_000_000
#: Kinds of moved rows: keys by range of hashes, shared keys by group of documents, facts.
KEY, SHARED_KEY, FACT = 0, 1, 2
KEYS = (("h", np.uint64), ("doc", np.int64), ("set", np.uint64), ("named", np.uint8))
FACTS = (("doc", np.int64), ("n", np.int32), ("set", np.uint64), ("more", np.uint64), ("named", np.uint8))
SHARED = (("doc", np.int64), ("h", np.uint64), ("times", np.int32))


def sets(texts: pa.Array, size: int) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
    """(sorted distinct shingle hashes of each text; a 128-bit digest of each set).  A shorter text is one shingle, one without words none."""
    hashes, first = words.words(texts, fold=True, keys=2)
    grams, more = words.ngrams(hashes[0], size), words.ngrams(hashes[1], size, 5)
    out, digests = [], []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            found, at = np.unique(grams[a : b - size + 1], return_index=True)
            second = more[a : b - size + 1][at]
        elif b > a:
            found, second = words.ngrams(hashes[0, a:b], b - a, b - a), words.ngrams(hashes[1, a:b], b - a, b - a)
        else:
            found = second = np.zeros(0, np.uint64)
        out.append(found)
        digests.append((xxhash.xxh3_64_intdigest(found.tobytes()), xxhash.xxh3_64_intdigest(second.tobytes(), 1)))
    return out, digests


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of ``n`` has in common with any set that it links to."""
    return -(-n * percent // 100)


def least_shared(n: int, percent: int) -> int:
    """Keys that a set of ``n`` shingles shares with any set that it links to."""
    return math.ceil(least_overlap(n, percent) * SHARE)


def key_count(n: int, percent: int) -> int:
    """How many of the smallest hashes are keys.

    Let o be ``least_overlap`` and l ``least_shared``.  n - o + l keys leave out
    o - l shingles.  Two linked sets have v >= both o in common; of the v, sorted,
    each set's keys hold all but the last o - l at most, so both hold the first
    v - max(o - l) >= l.  (l and o - l never fall as n grows.)
    """
    return n - least_overlap(n, percent) + least_shared(n, percent)


def bitmap(found: np.ndarray, bits_each: int = NARROW) -> np.ndarray:
    """Bits at the shingles' hashes, ``bits_each`` a shingle or more; the width is a power of two of whole 64-bit words."""
    width = max(64, 1 << int(bits_each * len(found) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(found >> np.uint64(8)) & np.uint64(width - 1)] = 1
    return np.packbits(bits)


def fold(signature: np.ndarray, width: int) -> np.ndarray:
    """A bitmap of a smaller power of two: the OR of its parts."""
    return np.bitwise_or.reduce(signature.reshape(-1, width), axis=0)


class Tree:
    """Levels of nodes over one block of sets, the leaves (single sets, sorted by size) first."""

    def __init__(self, n: np.ndarray, signatures: np.ndarray, comp: np.ndarray):
        bits = np.bitwise_count(signatures).sum(axis=1, dtype=np.int64)
        #: Per level: OR-combined bitmaps, least and greatest size, most shingles beyond the bits set, least and greatest component.
        self.levels = [(signatures, n, n, n - bits, comp, comp)]
        while len(self.levels[-1][1]) > 1:
            at = np.arange(0, len(self.levels[-1][1]), FANOUT)
            combine = (np.bitwise_or, np.minimum, np.maximum, np.maximum, np.minimum, np.maximum)
            self.levels.append(tuple(f.reduceat(x, at, axis=0) for f, x in zip(combine, self.levels[-1], strict=True)))


def possible(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """The overlap that is possible at most of pairs of nodes that may hold a link between two components, else -1."""
    (ors_a, low_a, high_a, beyond_a, *comps_a), (ors_b, low_b, high_b, beyond_b, *comps_b) = a, b
    fits = (100 * high_a[i] >= percent * low_b[j]) & (100 * high_b[j] >= percent * low_a[i])
    fits &= (comps_a[0][i] != comps_b[1][j]) | (comps_a[1][i] != comps_b[0][j])
    most = np.zeros(len(i), np.int64)
    at = np.flatnonzero(fits)
    for lo in range(0, len(at), 8_192):
        part = at[lo : lo + 8_192]
        common = np.bitwise_count(ors_a[i[part]] & ors_b[j[part]]).sum(axis=1, dtype=np.int64)
        most[part] = common + np.minimum(beyond_a[i[part]], beyond_b[j[part]])
    most = np.minimum(most, np.minimum(high_a[i], high_b[j]))
    return np.where(fits & (most * (100 + percent) >= percent * (low_a[i] + low_b[j])), most, -1)


def candidates(a: Tree, b: Tree, percent: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dual traversal from both roots: (leaf of a, leaf of b, possible overlap); ``same``: each pair of one tree once."""
    found = [(np.zeros(0, np.int64),) * 3]
    # depth first, some pairs at a time, so that the pairs at hand stay few
    waiting = [(len(a.levels) - 1, len(b.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while waiting:
        da, db, i, j = waiting.pop()
        if len(i) > PAIRS:
            waiting += [(da, db, i[lo : lo + PAIRS], j[lo : lo + PAIRS]) for lo in range(0, len(i), PAIRS)]
            continue
        most = possible(a.levels[da], b.levels[db], i, j, percent)
        keep = most >= 0
        if same and da == db:
            keep &= (i <= j) if da else (i < j)
        i, j, most = i[keep], j[keep], most[keep]
        if not da and not db:
            found.append((i, j, most))
            continue
        step = np.arange(FANOUT)
        if da >= db:
            i, j = (np.repeat(i * FANOUT, FANOUT) + np.tile(step, len(i))), np.repeat(j, FANOUT)
            da -= 1
            inside = i < len(a.levels[da][1])
            i, j = i[inside], j[inside]
        if db > da:
            i, j = np.repeat(i, FANOUT), (np.repeat(j * FANOUT, FANOUT) + np.tile(step, len(j)))
            db -= 1
            inside = j < len(b.levels[db][1])
            i, j = i[inside], j[inside]
        waiting.append((da, db, i, j))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def forest(n: int, i: np.ndarray, j: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places of the edges of a spanning forest, heaviest edges first."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    chosen = []
    order = np.argsort(-weight, kind="stable")
    for e, x, y in zip(order.tolist(), i[order].tolist(), j[order].tolist(), strict=True):
        a, b = root(x), root(y)
        if a != b:
            parent[a] = b
            chosen.append(e)
            if len(chosen) == n - 1:
                break
    return np.array(chosen, np.int64)


def overlaps(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of the sets a[i] and b[j]."""
    if len(i) <= len(a) + len(b):
        return np.array([len(np.intersect1d(a[x], b[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    # many pairs: count by products of 0/1 matrices, some columns (shingles in two sets at least) at a time
    flat = np.concatenate([*a, *b])
    owner = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in [*a, *b]])
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    keep = times[column] > 1
    owner, column = owner[keep], column[keep]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(a), len(b)), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        x, y = np.searchsorted(column, lo), np.searchsorted(column, lo + COLUMNS)
        dense = np.zeros((len(a) + len(b), COLUMNS), np.float32)
        dense[owner[x:y], column[x:y] - lo] = 1
        total += dense[: len(a)] @ dense[len(a) :].T
    return total[i, j].astype(np.int64)


def prepared(part: dict, every: bool) -> tuple[dict, list[np.ndarray], list[np.ndarray]]:
    """(the part sorted by size, its bitmaps, its sets if it carries those)."""
    order = np.lexsort((part["doc"], part["n"]))
    part = {k: v[order] for k, v in part.items()}
    if not every:
        return part, list(part["data"]), []
    found = [x.view(np.uint64) for x in part["data"]]
    return part, [bitmap(x, WIDE) for x in found], found


def join_group(left: dict, right: dict | None, percent: int, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of documents among one block, or between two.

    Without ``every`` the rows carry bitmaps, and the pairs are a spanning forest of
    the pairs that may link.  With it they carry the sets, all pairs between
    different components are judged, and the pairs are links that span what links.
    """
    parts = [prepared(p, every) for p in ([left] if right is None else [left, right])]
    width = min(min(map(len, bitmaps)) for _, bitmaps, _ in parts)
    trees = []
    for part, bitmaps, _ in parts:
        signatures = np.stack([fold(x, width) for x in bitmaps])
        trees.append(Tree(part["n"], np.ascontiguousarray(signatures).view(np.uint64), part["comp"]))
    (a, _, sets_a), (b, _, sets_b) = parts[0], parts[-1]
    i, j, most = candidates(trees[0], trees[-1], percent, right is None)
    total = a["n"][i] + b["n"][j]
    if every:
        most = overlaps(sets_a, sets_b, i, j)
        links = 100 * most >= percent * (total - most)
        i, j, most, total = i[links], j[links], most[links], total[links]
    names, place = np.unique(np.concatenate([a["comp"][i], b["comp"][j]]), return_inverse=True)
    e = forest(len(names), place[: len(i)], place[len(i) :], most / np.maximum(1, total - most))
    x, y = a["doc"][i[e]], b["doc"][j[e]]
    return np.minimum(x, y), np.maximum(x, y)


def group_pairs(members: DataFrame, percent: int, every: bool) -> DataFrame:
    """members: (bucket, token, i, j, side, doc, n, data, comp) -> distinct pairs (a, b), see :func:`join_group`."""

    def joined(table: pa.Table) -> pa.Table:
        column = {c: table.column(c).to_numpy() for c in ("token", "i", "j", "side", "doc", "n", "comp")}
        data = np.empty(len(table), object)
        data[:] = [np.frombuffer(x, np.uint8) for x in table.column("data").to_pylist()]
        order = np.lexsort((column["side"], column["j"], column["i"], column["token"]))
        column = {k: v[order] for k, v in column.items()} | {"data": data[order]}
        change = np.ones(len(order) + 1, bool)
        change[1:-1] = (np.diff(column["token"]) != 0) | (np.diff(column["i"]) != 0) | (np.diff(column["j"]) != 0)
        bounds = np.flatnonzero(change)
        xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            mid = lo + int(np.searchsorted(column["side"][lo:hi], 1))
            pick = lambda a, b: {k: column[k][a:b] for k in ("doc", "n", "data", "comp")}
            diagonal = column["i"][lo] == column["j"][lo]
            if hi - lo > 1 and (diagonal or lo < mid < hi):
                x, y = join_group(pick(lo, hi if diagonal else mid), None if diagonal else pick(mid, hi), percent, every)
                xs.append(x)
                ys.append(y)
        pairs = np.unique(np.stack([np.concatenate(xs), np.concatenate(ys)], 1), axis=0)
        del data, column
        blobs.tidy()
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return members.groupBy("bucket").applyInArrow(joined, "a long, b long").distinct()


def compare(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by exact intersection of their sets."""
    left = known.select(F.col("doc").alias("a"), F.col("shingles").alias("sa"))
    right = known.select(F.col("doc").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for sa, sb in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(sa.as_buffer(), np.uint64), np.frombuffer(sb.as_buffer(), np.uint64)
                z = np.concatenate((x, y))
                z.sort(kind="stable")
                common = int((z[1:] == z[:-1]).sum())
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(linked, "a long, b long")


def blocks(labelled: DataFrame, percent: int) -> DataFrame:
    """(token, doc, comp, i, j, side): which blocks of a group meet, for the rows (token, size, doc, n, comp) of groups that span components.

    A group of up to ``WHOLE_BLOCK`` sets is one block.  A larger one is dealt by
    component (those of more than a block) and by range of sizes, each range as wide
    as a link allows, into blocks; a block meets those of its own and the next range,
    but none of its own component.
    """
    small = labelled.where(F.col("size") <= WHOLE_BLOCK).select("token", "doc", "comp", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).alias("side"))
    large = labelled.where(F.col("size") > WHOLE_BLOCK)
    big = large.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("of_comp")).where(F.col("of_comp") > WHOLE_BLOCK).select("token", "comp", F.col("comp").alias("tag"))
    step = math.log(100 / percent) * 1.0001 if percent < 100 else 0.0001
    ranged = large.join(big, ["token", "comp"], "left").withColumn("range", F.floor(F.log("n") / step))
    place = ["token", "tag", "range"]
    many = ranged.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / WHOLE_BLOCK).cast("long").alias("blocks"))
    same = (F.col("r.token") == F.col("m.token")) & F.col("r.tag").eqNullSafe(F.col("m.tag")) & (F.col("r.range") == F.col("m.range"))
    dealt_to = F.pmod(F.xxhash64("r.token", "doc"), F.col("blocks"))
    ranged = ranged.alias("r").join(many.alias("m"), same).select(*(f"r.{c}" for c in place), "doc", "comp", F.xxhash64("r.tag", "r.range", dealt_to).alias("block"))
    ranged = materialise(ranged, "ranged")  # read several times
    found = ranged.select(*place, "block").distinct()
    a = found.select("token", F.col("tag").alias("tag_a"), F.col("block").alias("i"), F.col("range").alias("range_a"), F.explode(F.array("range", F.col("range") + 1)).alias("range"))
    b = found.select("token", F.col("tag").alias("tag_b"), F.col("block").alias("j"), "range")
    meet = a.join(b, ["token", "range"]).where("(range_a < range OR i <= j) AND (tag_a IS NULL OR tag_b IS NULL OR tag_a != tag_b)").select("token", "i", "j")
    sides = F.when(F.col("i") == F.col("j"), F.array(F.struct(F.col("i").alias("block"), F.lit(0).alias("side")))).otherwise(F.array(F.struct(F.col("i").alias("block"), F.lit(0).alias("side")), F.struct(F.col("j").alias("block"), F.lit(1).alias("side"))))
    tasks = meet.select("token", "i", "j", F.explode(sides).alias("x")).select("token", "i", "j", "x.*")
    return small.unionByName(ranged.join(tasks, ["token", "block"]).select("token", "doc", "comp", "i", "j", "side"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (smallest id reachable by links, itself included), set_id (smallest id with an equal set).

    A-Z count as a-z; words are longest runs of bytes other than 0x20 and
    0x09-0x0D.  Null text and text without words have no shingles and link with
    nothing.  Ids are integers.  A repeated row gives repeated results; rows of one id
    with different texts are one document that has the links of all of them; a row
    with a null id links with nothing and has null component_id and set_id; other
    columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("body"))
    parts = parts_of(spark, source.agg(F.sum(F.octet_length("body"))).first()[0])

    def packed(sent: dict) -> list[tuple[int, int, bytes]]:
        """A batch's keys, one for each key and set."""
        sent = blobs.take(sent, np.lexsort((sent["doc"], sent["set"], sent["h"])))
        new = np.ones(len(sent["h"]), bool)
        new[1:] = (sent["h"][1:] != sent["h"][:-1]) | (sent["set"][1:] != sent["set"][:-1])
        sent = blobs.take(sent, np.flatnonzero(new))
        return [(KEY, *x) for x in blobs.split(sent, (sent["h"] % np.uint64(1 << 40) >> np.uint64(8)).astype(np.int64) % parts, KEYS)]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, 1):
                ids, (found, digests) = doc_ids(part.column(0)), sets(part.column(1), shingle)
                named = part.column(0).is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
                low = np.array([d[0] for d in digests], np.uint64)
                facts = {"doc": ids, "n": np.array([len(s) for s in found], np.int32), "set": low, "more": np.array([d[1] for d in digests], np.uint64), "named": named}
                counts = [key_count(len(s), percent) if k else 0 for s, k in zip(found, named, strict=True)]
                owner = np.repeat(np.arange(len(found)), counts)
                held.append({"h": np.concatenate([s[:k] for s, k in zip(found, counts, strict=True)]), "doc": ids[owner], "set": low[owner], "named": named[owner]})
                size += len(owner)
                yield table_of([(FACT, int(blobs.group_of(ids[:1], parts)[0]), blobs.pack(facts, FACTS))])
                if size >= PACKED:
                    yield table_of(packed(blobs.concat(held)))
                    held, size = [], 0
        if size:
            yield table_of(packed(blobs.concat(held)))
        blobs.tidy()

    def shared(table: pa.Table) -> pa.Table:
        """Keys of two different sets or more, with their number of sets, at the smallest document of each."""
        if table.column("kind")[0].as_py() != KEY:
            return table
        found = blobs.unpack(table.column("data").to_pylist(), KEYS)
        found = blobs.take(found, np.lexsort((found["doc"], found["set"], found["h"])))
        new = np.ones(len(found["h"]), bool)
        new[1:] = (found["h"][1:] != found["h"][:-1]) | (found["set"][1:] != found["set"][:-1])
        found = blobs.take(found, np.flatnonzero(new))
        _, at, times = np.unique(found["h"], return_inverse=True, return_counts=True)
        alive = np.flatnonzero(times[at] > 1) if len(at) else at
        out = {"doc": found["doc"][alive], "h": found["h"][alive], "times": times[at][alive] if len(at) else at}
        return pa.Table.from_batches([table_of([(SHARED_KEY, *x) for x in blobs.split(out, blobs.group_of(out["doc"], parts), SHARED)])])

    first = materialise(dealt(source.mapInArrow(keys, MOVED), parts, "kind", "key").groupBy("kind", "key").applyInArrow(shared, MOVED), "keys")
    kept_schema = "doc long, n long, signature binary, shingles binary, tokens array<long>"

    def survivors(texts: pa.Table, moved: pa.Table) -> pa.Table:
        found = blobs.unpack(moved.column("data").to_pylist(), SHARED)
        # rarest first: a link shares `least` keys, so it shares one of the rarest (keys - least + 1) of either side, and hot keys fall away
        found = blobs.take(found, np.lexsort((found["h"], found["times"], found["doc"])))
        texts = texts.filter(pa.array(np.isin(doc_ids(texts.column("doc").combine_chunks()), found["doc"])))
        out: dict[str, list] = {"doc": [], "n": [], "signature": [], "shingles": [], "tokens": []}
        seen: set[tuple] = set()
        for batch in texts.combine_chunks().to_batches():
            for part in slices(batch, 1):
                for doc, s, digest in zip(part.column(0).to_pylist(), *sets(part.column(1), shingle), strict=True):
                    if doc is None or (doc, *digest) in seen:
                        continue
                    own = found["h"][np.searchsorted(found["doc"], doc, "left") : np.searchsorted(found["doc"], doc, "right")]
                    own = own[np.isin(own, s[: key_count(len(s), percent)])]
                    least = least_shared(len(s), percent)
                    if len(s) and len(own) >= least:
                        seen.add((doc, *digest))
                        for name, value in (("doc", doc), ("n", len(s)), ("signature", bitmap(s).tobytes()), ("shingles", s.tobytes()), ("tokens", own[: len(own) - least + 1].view(np.int64))):
                            out[name].append(value)
        kinds = {"doc": pa.int64(), "n": pa.int64(), "signature": pa.binary(), "shingles": pa.binary(), "tokens": pa.list_(pa.int64())}
        return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})

    texts = dealt(source.where(F.col("doc").isNotNull()).withColumn("key", group_column(F.col("doc"), parts)), parts, "key")
    alive = dealt(first.where(F.col("kind") == SHARED_KEY).select("key", "data"), parts, "key")
    known = materialise(texts.groupBy("key").cogroup(alive.groupBy("key")).applyInArrow(survivors, kept_schema), "survivors")
    rarest = known.select("doc", F.explode("tokens").alias("token"))
    # keys whose smallest document is the same are one group, named by it: keys of one passage, or of one family, have mostly the same documents
    leaders = rarest.groupBy("token").agg(F.min("doc").alias("leader"), F.max("doc").alias("most")).where("leader < most").select("token", "leader")
    # written, so that both sides of the joins are plain exchanges, which AQE splits at hot keys
    led = materialise(rarest.join(materialise(leaders, "leaders"), "token").select(F.col("leader").alias("token"), "doc").distinct(), "led")
    named = materialise(led.groupBy("token").agg(F.count(F.lit(1)).alias("size")), "group-sizes")
    groups_of = materialise(led.join(named, "token").select("token", "size", "doc"), "groups")
    discard(led)

    def carried(spread: DataFrame, data: str) -> DataFrame:
        signed = spread.join(known.select("doc", "n", F.col(data).alias("data")), "doc")
        return signed.withColumn("bucket", F.pmod(F.xxhash64("token", "i", "j"), F.lit(4 * parts)))

    own = F.pmod(F.xxhash64("token", "doc"), F.ceil(F.col("size") / BLOCK).cast("long"))
    alone = groups_of.select("token", "doc", F.col("doc").alias("comp"), own.alias("i"), own.alias("j"), F.lit(0).alias("side"))
    pairs = materialise(group_pairs(carried(alone, "signature"), percent, False), "pairs")
    links = materialise(compare(pairs, known, percent), "links")
    comps = connected_components(links, "a", "b")
    labelled = groups_of.join(comps, groups_of["doc"] == comps["node"], "left").select("token", "size", "doc", F.coalesce("component", "doc").alias("comp"))
    labelled = materialise(labelled, "labelled")
    open_tokens = labelled.groupBy("token").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least < most").select("token")
    sizes = known.select("doc", "n").distinct()
    spread = blocks(labelled.join(open_tokens, "token").join(sizes, "doc"), percent)
    more = materialise(group_pairs(carried(spread, "shingles"), percent, True), "links")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = blobs.unpack(batch.column(0).to_pylist(), FACTS)
            named = found["named"].astype(bool)
            columns = [pa.array(found["doc"], mask=~named), pa.array(found["n"].astype(np.int64)), pa.array(found["set"].view(np.int64)), pa.array(found["more"].view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "n", "s1", "s2"])

    facts = materialise(first.where(F.col("kind") == FACT).select("data").mapInArrow(told, "doc long, n long, s1 long, s2 long"), "facts")
    some = facts.where("n > 0 AND doc IS NOT NULL")
    same = materialise(some.groupBy("n", "s1", "s2").agg(F.min("doc").alias("set_id")), "equal-sets")
    with_set = materialise(some.join(same, ["n", "s1", "s2"]).select("doc", "n", "set_id"), "sets-of-documents")
    # rows of one id with different sets are one document
    several = with_set.groupBy("doc").agg(F.min("set_id").alias("a"), F.max("set_id").alias("most")).where("a < most")
    own_sets = with_set.join(several, "doc").select("a", F.col("set_id").alias("b")).where("a != b").distinct()
    final = connected_components(links.union(more).union(own_sets), "a", "b")
    found = with_set.join(final, with_set["set_id"] == final["node"], "left").select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "set_id").alias("component_id"), "set_id")
    none = facts.where("n = 0 OR doc IS NULL").select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.col("doc").alias("component_id"), F.col("doc").alias("set_id"))
    for done in (first, known, named, groups_of, pairs, links, labelled, more, same):
        discard(done)
    return found.unionByName(none)
