"""Approximate nearest neighbours by randomly rotated one-bit codes (operator 8).

A vector's residual to the mean is rotated at random and each coordinate kept as one
bit.  A query's rotated residual is rounded to ``QUERY_BITS`` bits, whose planes are
matched with the packed codes by counting bits.  With two scalars, the residual's
length and its inner product with the code, this estimates the inner product of the
residuals; its error is bounded with high probability.  The estimates' best are
compared exactly, which gives a distance to beat, and every vector whose bound allows
it to beat that distance is compared exactly as well.

Every row has a code.  A stated set of queries is searched against all rows in
blocks: rows are dealt into slices and queries into blocks, both of tens of thousands,
and each (block, slice) is one task that returns its best ``k`` per query.  Rows travel
once for each block of queries, so only once up to ``QUERY_BLOCK`` queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blobs, vectors
from .common import dealt, materialise, shuffle_partitions

K = 10
#: Queries and rows that meet in a task at most (about).
QUERY_BLOCK, SLICE = 16_384, 32_768
#: Bits of a query's coordinate; factor of the error bound (a bound fails with a chance of about exp(-2 x 2.5 ** 2 / 2)).
QUERY_BITS, ERROR_FACTOR = 4, 2.5
#: Lengths of vectors, the most frequent ones, that have a mean; others are taken from 0.  Sums of vectors that reach the driver for each.
MEANS, PARTIAL_SUMS = 16, 16
SEED = 7


def means(rows: DataFrame) -> dict[int, np.ndarray]:
    """The mean of all vectors of each length, added up on the executors."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            dims, data = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for dim in np.unique(dims).tolist():
                x = vectors.matrix([data[k] for k in np.flatnonzero(dims == dim)])
                n, total = sums.get(dim, (0, 0.0))
                sums[dim] = (n + len(x), total + x.sum(axis=0))
        yield pa.RecordBatch.from_pydict({"dim": pa.array(list(sums), pa.int32()), "n": pa.array([n for n, _ in sums.values()], pa.int64()), "total": pa.array([s.tobytes() for _, s in sums.values()], pa.binary())})

    def added(table: pa.Table) -> pa.Table:
        total = vectors.matrix(table.column("total").to_pylist()).sum(axis=0)
        return pa.table({"dim": table.column("dim")[:1], "n": pa.array([sum(table.column("n").to_pylist())]), "total": pa.array([total.tobytes()], pa.binary())})

    sums = rows.select("dim", "data").mapInArrow(partial, "dim int, n long, total binary").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTIAL_SUMS)))
    sums = materialise(sums.groupBy("dim", "part").applyInArrow(added, "dim int, n long, total binary"), "sums")
    frequent = [r[0] for r in sums.groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "dim").limit(MEANS).collect()]
    found: dict[int, list] = {}
    for dim, n, total in sums.where(F.col("dim").isin(frequent)).collect():
        found.setdefault(dim, []).append((n, np.frombuffer(total, np.float64)))
    middles = {dim: sum(s for _, s in parts) / sum(n for n, _ in parts) for dim, parts in found.items()}
    return {dim: m for dim, m in middles.items() if np.isfinite(m).all()}


def residuals(x: np.ndarray, middle: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(rotated unit residuals, their lengths)."""
    rest = vectors.rotated(vectors.padded(x if middle is None else x - middle), SEED)
    norm = np.linalg.norm(rest, axis=1)
    return rest / np.where(norm > 0, norm, 1)[:, None], norm


def encode(x: np.ndarray, middle: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed one-bit codes, lengths of the residuals, inner products of code and residual)."""
    unit, norm = residuals(x, middle)
    return np.packbits(unit > 0, axis=1), norm, np.abs(unit).sum(axis=1) / np.sqrt(unit.shape[1])


def in_words(packed: np.ndarray) -> np.ndarray:
    """Packed bits as 64-bit words, [words, rows]; the rest of the last word is 0."""
    padded = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))
    return np.ascontiguousarray(np.ascontiguousarray(padded).view(np.uint64).T)


def planes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rounded queries: (bit planes [queries, bits, words], least coordinates, steps, lengths of what rounding leaves)."""
    low = unit.min(axis=1)
    step = np.maximum((unit.max(axis=1) - low) / (2**QUERY_BITS - 1), 1e-300)
    level = np.rint((unit - low[:, None]) / step[:, None]).astype(np.uint8)
    left = np.linalg.norm(unit - (low[:, None] + level * step[:, None]), axis=1)
    bits = [in_words(np.packbits((level >> b) & 1, axis=1)).T for b in range(QUERY_BITS)]
    return np.stack(bits, 1), low, step, left


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(axis=1))


def search(queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, packed: np.ndarray, norm: np.ndarray, correction: np.ndarray, middle: np.ndarray | None, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query (ids, distances) of its best ``k`` rows found, nearest first, ties to smaller ids, each id once."""
    unit, length = residuals(queries, middle)
    width = unit.shape[1]
    code = in_words(packed)
    ones = np.bitwise_count(code).sum(axis=0, dtype=np.int64)
    safe = np.where(correction > 0, correction, 1)
    spread = ERROR_FACTOR / np.sqrt(max(1, width - 1))
    of_code = np.sqrt(np.maximum(0, 1 - safe**2)) / safe * spread
    bits, low, step, left = planes(unit)
    for row, query in enumerate(queries):
        matched = np.zeros(len(ids), np.int64)
        for b in range(QUERY_BITS):
            for w in range(len(code)):
                matched += np.bitwise_count(code[w] & bits[row, b, w]).astype(np.int64) << b
        whole = low[row] * width + step[row] * np.sum([np.bitwise_count(bits[row, b]).sum(dtype=np.int64) << b for b in range(QUERY_BITS)])
        inner = (2 * (low[row] * ones + step[row] * matched) - whole) / np.sqrt(width) / safe
        error = of_code + left[row] * spread / safe
        both, cross = norm**2 + length[row] ** 2, 2 * norm * length[row]
        other = np.flatnonzero(ids != query_ids[row])
        estimate = (both - cross * inner)[other]
        first = other[np.argpartition(estimate, k - 1)[:k]] if len(other) > k else other
        # ids may repeat with several vectors: then the first k are fewer candidates, and all are looked at
        few = len(other) <= k or len(np.unique(ids[first])) < k
        beat = np.inf if few else exact(query, x[first]).max()
        least = (both - cross * (inner + error))[other]
        chosen = np.union1d(other[least <= beat * beat * (1 + 1e-9) + 1e-12], first)
        distance = exact(query, x[chosen])
        order = np.lexsort((ids[chosen], distance))
        _, once = np.unique(ids[chosen][order], return_index=True)
        order = order[np.sort(once)[:k]]
        yield ids[chosen][order], distance[order]


def nearest(df: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's ``k`` nearest rows found by Euclidean distance: query_id, rank (from 1), the id, score.

    ``is_query`` is a condition on the column ``id``.  Candidates are all rows but
    the query's own, of the query's length; fewer than ``k`` are all returned.
    Vectors that are null, empty, zero or hold null or non-finite components, and
    rows with null ids, take no part.  Rows repeated with one id and vector count
    once; of rows of one id with different vectors the nearest counts, as query and
    as candidate.  Ties go to the smaller id.  Other columns are not read; an empty
    table gives no rows.
    """
    spark = df.sparkSession
    rows = materialise(vectors.read(df, id_col, vector_col), "vectors")
    middles = means(rows)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                part = batch.take(pa.array(at))
                codes, norm, correction = encode(vectors.matrix(part.column(2).to_pylist()), middles.get(int(dim)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm), pa.array(correction)], names=["id", "dim", "data", "code", "norm", "correction"])

    index = rows.mapInArrow(coded, "id long, dim int, data binary, code binary, norm double, correction double")
    queries = rows.where(is_query).distinct()
    blocks = max(1, -(-rows.where(is_query).count() // QUERY_BLOCK))
    slices = max(shuffle_partitions(spark), -(-rows.count() // SLICE))
    each = F.xxhash64("id", "data")  # rows repeated whole share a slice
    dealt_queries = queries.select("id", "dim", "data", F.pmod(each, F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    dealt_rows = index.select("*", F.pmod(each, F.lit(slices)).cast("int").alias("slice"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

    def joined(q: pa.Table, x: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "id": [], "score": []}
        if len(q) and len(x):
            dims, data = x.column("dim").to_numpy(), x.column("data").to_pylist()
            codes = x.column("code").to_pylist()
            ids, norm, correction = (x.column(c).to_numpy() for c in ("id", "norm", "correction"))
            query_dims, query_data, query_ids = q.column("dim").to_numpy(), q.column("data").to_pylist(), q.column("id").to_numpy()
            for dim in np.unique(query_dims):
                at, of = np.flatnonzero(dims == dim), np.flatnonzero(query_dims == dim)
                if not len(at):
                    continue
                seen = {(ids[r], data[r]): r for r in at.tolist()}  # rows repeated whole count once
                at = np.array(sorted(seen.values()))
                packed = np.frombuffer(b"".join(codes[r] for r in at), np.uint8).reshape(len(at), -1)
                near = vectors.matrix([data[r] for r in at])
                for lo in range(0, len(of), 512):
                    asked = of[lo : lo + 512]
                    found = search(vectors.matrix([query_data[r] for r in asked]), query_ids[asked], near, ids[at], packed, norm[at], correction[at], middles.get(int(dim)), k)
                    for query, (best, distance) in zip(query_ids[asked].tolist(), found, strict=True):
                        out["query_id"] += [query] * len(best)
                        out["id"] += best.tolist()
                        out["score"] += distance.tolist()
        blobs.tidy()
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "id": pa.array(out["id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    key, tasks = ("block", "slice"), blocks * slices
    best = dealt(dealt_queries, tasks, *key).groupBy(*key).cogroup(dealt(dealt_rows, tasks, *key).groupBy(*key)).applyInArrow(joined, "query_id long, id long, score double")
    best = best.groupBy("query_id", "id").agg(F.min("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy("score", "id")  # slices x k rows a query
    ranked = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
