"""Embedding near-duplicates by cross-polytope hashing (operator 5).

A hash rotates the unit vector by signs and fast Hadamard transforms and names the
largest coordinate with its sign: the nearest corner of a cross-polytope.  A table
joins several of them, and each vector probes the buckets of its ``PROBES`` best
corners per hash; vectors that share a bucket of any table, and the label, are
compared in double precision.  A pair is counted only in the first bucket that it
shares, so links are counted once without listing them.

How many hashes a table joins follows from the number of vectors of the most
frequent label, so that buckets stay small however large the table is; the number of
tables grows with it, so that about as many pairs are found at every size.

Equal vectors collapse first.  A large bucket is dealt into blocks, whose pairs are
separate tasks; only link counts and spanning links leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blobs, vectors, words
from .common import connected_components, dealt, discard, materialise, parts_of
from .shingles import forest

THRESHOLD = 0.93
#: Corners probed per hash.
PROBES = 2
#: Vectors that a bucket holds by chance at most (on average), and hashes of a table at least and at most.
BY_CHANCE, LEAST_HASHES, MOST_HASHES = 16, 2, 6
#: Rows of a block of a large bucket; buckets up to SMALL rows are compared together; pairs at hand at a time.
BLOCK, SMALL, PAIRS = 1024, 48, 32_768


def hashes_for(vectors_of_label: int, dim: int) -> int:
    """Hashes that a table joins for this many vectors of one label."""
    share, corners = 1.0, 2 << max(0, dim - 1).bit_length()
    for hashes in range(1, MOST_HASHES + 1):
        share *= min(PROBES, corners) / corners
        if hashes >= LEAST_HASHES and vectors_of_label * share <= BY_CHANCE:
            return hashes
    return MOST_HASHES


def tables_for(hashes: int) -> int:
    """Tables that find all but about 6 in a million pairs at the threshold, in 64 dimensions (each hash agrees with a chance of 0.88)."""
    return 3 * hashes + 2


def codes(x: np.ndarray, hashes: int) -> np.ndarray:
    """Buckets of each unit vector: [rows, tables * PROBES ** hashes], tables in order and sorted within; the table is a bucket's first byte."""
    unit = vectors.padded(x)
    width = unit.shape[1]
    out = []
    for table in range(tables_for(hashes)):
        corners = []
        for k in range(hashes):
            turned = vectors.rotated(unit, 1000 * table + k)
            best = np.argsort(-np.abs(turned), axis=1, kind="stable")[:, : min(PROBES, width)]
            corners.append((best * 2 + (np.take_along_axis(turned, best, 1) < 0)).astype(np.uint64))
        own, plain = [], (2 * width) ** hashes < 2**55  # small numbers travel compressed
        for probe in product(range(corners[0].shape[1]), repeat=hashes):
            h = np.zeros(len(x), np.uint64)
            for c, p in zip(corners, probe, strict=True):
                h = h * np.uint64(2 * width) + c[:, p] if plain else words.mix(h * np.uint64(0x9E3779B97F4A7C15) + c[:, p] + np.uint64(1))
            own.append(h if plain else h >> np.uint64(8))
        out.append(np.sort(np.stack(own, 1), axis=1) | np.uint64(table << 56))
    return np.concatenate(out, 1).astype(np.int64)


def first_shared(a: np.ndarray, b: np.ndarray, bucket: np.ndarray, tables: int) -> np.ndarray:
    """Which pairs of rows of buckets share no bucket before ``bucket``."""
    each = a.shape[1] // tables
    own = bucket >> 56
    first = np.ones(len(a), bool)
    for t in range(int(own.max(initial=-1)) + 1):
        # only pairs that no table before told apart from the first, and whose bucket isn't of an earlier table
        at = np.flatnonzero(first & (own >= t))
        x, y = a[at, t * each : (t + 1) * each], b[at, t * each : (t + 1) * each]
        shared = np.zeros(len(at), bool)
        for p in range(each):
            shared |= ((x[:, p : p + 1] == y) & (y < bucket[at, None])).any(axis=1)
        first[at] = ~shared
    return first


class Judge:
    """Rows of one length in one task: which pairs link, judged in double precision."""

    def __init__(self, x: np.ndarray, own: np.ndarray, bucket: np.ndarray, tables: int, threshold: float):
        self.x, self.own, self.bucket, self.tables, self.threshold = x, own, bucket, tables, threshold
        self.norm = np.linalg.norm(x, axis=1)
        self.left: list[np.ndarray] = []
        self.right: list[np.ndarray] = []

    def pairs(self, i: np.ndarray, j: np.ndarray, doubtful: np.ndarray | None = None) -> None:
        """Keep the pairs that link, where the bucket is the first that they share.  With ``doubtful`` the others are known to link."""
        for lo in range(0, len(i), PAIRS):
            a, b = i[lo : lo + PAIRS], j[lo : lo + PAIRS]
            near = np.ones(len(a), bool)
            at = np.arange(len(a)) if doubtful is None else np.flatnonzero(doubtful[lo : lo + PAIRS])
            near[at] = np.einsum("ij,ij->i", self.x[a[at]], self.x[b[at]]) / (self.norm[a[at]] * self.norm[b[at]]) >= self.threshold
            a, b = a[near], b[near]
            good = first_shared(self.own[a], self.own[b], self.bucket[a], self.tables)
            self.left.append(a[good])
            self.right.append(b[good])

    def small(self, group: np.ndarray) -> None:
        """All pairs of rows that are neighbours in sorted order and of one group."""
        for step in range(1, SMALL):
            at = np.flatnonzero(group[step:] == group[:-step])
            if not len(at):
                break
            self.pairs(at, at + step)

    def block(self, a: np.ndarray, b: np.ndarray | None) -> None:
        """All pairs of rows ``a`` (with ``b``: of a and b): a product of matrices names those that may link."""
        unit = lambda rows: self.x[rows] / self.norm[rows, None]
        cosine = unit(a) @ unit(a if b is None else b).T
        near = cosine >= self.threshold - 1e-9
        if b is None:
            near &= np.triu(np.ones(near.shape, bool), 1)
        i, j = np.nonzero(near)
        self.pairs(a[i], (a if b is None else b)[j], cosine[i, j] < self.threshold + 1e-9)


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``df``: id, n_links (other vectors linked directly), component_id (smallest id reachable, itself included), kept (id = component_id).

    Vectors are compared if their labels are equal and not null and their lengths
    are equal.  A vector that is null, empty, zero or holds null or non-finite
    components, or has a null label or id, links with nothing.  Rows that repeat id,
    label and vector are one vector; rows of one id with different vectors are
    different vectors.  Vectors of any finite size are compared (each is scaled by a
    power of two first).  Other columns are not read; an empty table gives no rows.
    """
    spark = df.sparkSession
    named = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    rows = vectors.read(named.withColumn("vector", F.expr("CASE WHEN id IS NOT NULL AND label IS NOT NULL THEN vector END")), "id", "vector", "label", whole=True)
    rows = materialise(rows.withColumn("digest", F.sha2("data", 256)), "vectors")
    usable = rows.where(F.col("data").isNotNull())
    once = usable.groupBy("label", "digest", "id").agg(F.first("dim").alias("dim"), F.first("data").alias("data"))
    reps = once.groupBy("label", "digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("dim").alias("dim"), F.first("data").alias("data"))
    reps = materialise(reps.withColumn("node", F.monotonically_increasing_id()), "distinct-vectors")  # numbers are fixed once written
    most, dim = reps.groupBy("label", "dim").count().agg(F.max("count"), F.min("dim")).first()
    hashes = hashes_for(most or 0, dim or 1)
    tables = tables_for(hashes)
    # vectors of 32-bit components travel so
    kind = np.float32 if df.schema[vector_col].dataType == T.ArrayType(T.FloatType(), df.schema[vector_col].dataType.containsNull) else np.float64
    schema = T.StructType([*(T.StructField(c, reps.schema[c].dataType) for c in ("node", "label", "dim", "copies", "data")), T.StructField("codes", T.ArrayType(T.LongType()))])
    names = [f.name for f in schema.fields]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                whole = vectors.matrix(part.column("data").to_pylist())
                x = vectors.scaled(whole)
                found = codes(x / np.linalg.norm(x, axis=1, keepdims=True), hashes)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32()), pa.array(found.reshape(-1)))
                data = pa.array([row.tobytes() for row in whole.astype(kind)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], data, flat], names=names)

    known = materialise(reps.select(*names[:-1]).mapInArrow(hashed, schema), "hashed-vectors")
    in_bucket = known.select("node", "label", "dim", F.explode("codes").alias("bucket"))
    key = ["label", "dim", "bucket"]
    blocks = F.ceil(F.col("size") / BLOCK).cast("long")
    # written, so that both sides of the join are plain exchanges, which AQE splits at a hot bucket
    sizes = materialise(in_bucket.groupBy(*key).agg(F.count(F.lit(1)).alias("size")).where("size > 1").withColumn("blocks", blocks), "bucket-sizes")
    moved = sizes.agg(F.sum(F.col("size") * F.col("blocks") * (F.col("dim") * np.dtype(kind).itemsize + 8 * tables * PROBES**hashes))).first()[0]
    tasks = parts_of(spark, moved)
    spread = in_bucket.join(sizes, key).withColumn("own", F.pmod(F.xxhash64("node", "bucket"), F.col("blocks")))
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j"), (F.col("own") > k).cast("int").alias("side")))
    members = spread.select("node", *key, F.explode(others).alias("b")).select("node", *key, "b.*")
    carried = members.join(known.select("node", "copies", "data", "codes"), "node").withColumn("task", F.pmod(F.xxhash64(*key, "i", "j"), F.lit(4 * tasks)))

    def linked(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        column = {c: table.column(c).to_numpy() for c in ("node", "dim", "bucket", "i", "j", "side", "copies")}
        labels = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        nodes, others, counts = [], [], []
        for dim in np.unique(column["dim"]):
            at = np.flatnonzero(column["dim"] == dim)
            at = at[np.lexsort((column["node"][at], column["side"][at], column["j"][at], column["i"][at], column["bucket"][at], labels[at]))]
            part = {c: v[at] for c, v in column.items()}
            new = np.ones(len(at), bool)
            new[1:] = np.any([v[1:] != v[:-1] for v in (labels[at], part["bucket"], part["i"], part["j"])], axis=0)
            bounds = np.flatnonzero(np.append(new, True))
            taken = table.take(pa.array(at))
            own = taken.column("codes").combine_chunks().flatten().to_numpy().reshape(len(at), -1)
            judge = Judge(vectors.scaled(vectors.matrix(taken.column("data").to_pylist(), kind)), own, part["bucket"], tables, threshold)
            group, alone = np.cumsum(new), part["i"] == part["j"]
            size = np.diff(bounds)
            # a group that isn't small, or that meets two blocks, is judged by itself
            apart = (size > SMALL) | ~alone[bounds[:-1]]
            judge.small(np.where(apart[group - 1], -np.arange(1, len(at) + 1), group))
            for lo, hi in zip(bounds[:-1][apart].tolist(), bounds[1:][apart].tolist(), strict=True):
                whole = np.arange(lo, hi)
                mid = lo + int(np.searchsorted(part["side"][lo:hi], 1))
                if alone[lo]:
                    judge.block(whole, None)
                elif lo < mid < hi:
                    judge.block(whole[: mid - lo], whole[mid - lo :])
            i, j = np.concatenate([*judge.left, np.zeros(0, np.int64)]), np.concatenate([*judge.right, np.zeros(0, np.int64)])
            if len(i):
                names_, place = np.unique(np.concatenate([part["node"][i], part["node"][j]]), return_inverse=True)
                a, b = place[: len(i)], place[len(i) :]
                n = np.bincount(a, part["copies"][j], len(names_)) + np.bincount(b, part["copies"][i], len(names_))
                e = forest(len(names_), a, b, np.zeros(len(a)))
                nodes += [names_, names_[a[e]]]
                others += [np.full(len(names_), -1), names_[b[e]]]  # -1: a count, no link
                counts += [n.astype(np.int64), np.zeros(len(e), np.int64)]
        blobs.tidy()
        whole = lambda parts: np.concatenate([*parts, np.zeros(0, np.int64)])
        return pa.table({"a": whole(nodes), "b": whole(others), "n": whole(counts)})

    found = materialise(dealt(carried, tasks, "task").groupBy("task").applyInArrow(linked, "a long, b long, n long"), "links")
    counts = found.where("b < 0").groupBy("a").agg(F.sum("n").alias("n"))
    comps = connected_components(found.where("b >= 0").select("a", "b"), "a", "b")
    in_comp = comps.join(reps.select("node", "rep"), "node")
    least = in_comp.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_node = in_comp.join(least, "component").select("node", "component_id")
    per_rep = reps.select("label", "digest", "node", "rep", "copies").join(counts, F.col("node") == F.col("a"), "left").join(of_node, "node", "left")
    per_rep = per_rep.select("label", "digest", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    per_rep = materialise(per_rep, "linked-vectors")
    for done in (known, sizes, found, reps):
        discard(done)
    out = rows.select("id", "label", "digest").join(per_rep, ["label", "digest"], "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
