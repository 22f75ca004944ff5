"""Best-fit packing of tokenised documents into fixed-length sequences (operator 7).

Method: large-item matching.  Pieces above one third of the capacity fit at most
twice into a sequence, so they are matched greedily (largest with the largest
partner that fits, which gives the most pairs); smaller pieces then go, in
decreasing order, to the tightest gap that holds them.

Lengths are integers from 1 to the capacity, so the whole corpus is described by
one histogram of at most ``capacity`` counts.  The driver packs the *histogram*
(whole groups of equal sequences at a time) into a recipe whose size depends on
the capacity alone.  Executors then number the pieces of each length and look
their place up in the recipe: no document, piece or id ever reaches the driver,
and the same global packing results for any number of partitions.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, shuffle_partitions
from .tokens import encoder

CAPACITY, END_ID = 1024, 2


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first piece may be shorter than the capacity."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 (and the ids themselves with ``keep_ids``)."""
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))
    end = np.array([end_id], dtype="<u4").tobytes()

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(vocabulary).ids
        for batch in batches:
            rows, piece, start, length, crc, kept = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                data = memoryview((ids_of(text.as_py() or "") if text.is_valid else b"") + end)
                for k, (s, n) in enumerate(cut(len(data) // 4, capacity)):
                    part = data[4 * s : 4 * (s + n)]
                    rows.append(row)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        kept.append(np.frombuffer(part, "<u4").astype("i8"))
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.select(id_col, text_col).mapInArrow(tokenise, T.StructType(fields))


def recipe(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Pack a histogram of lengths: rows (length, first rank, count, first sequence, pieces per sequence, offset).

    Pieces ``lo .. lo+count`` of a length go to sequences ``first + i // per`` at
    ``offset + (i % per) * length``.
    """
    left = {n: c for n, c in histogram.items() if c}
    used: dict[int, int] = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    sequences = 0

    def place(n: int, count: int, first: int, per: int, offset: int) -> None:
        rows.append((n, used[n], count, first, per, offset))
        used[n] += count
        left[n] -= count

    def open_gap(gap: int, first: int, many: int) -> None:
        if gap and many:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((first, many))

    large = sorted(n for n in left if 3 * n > capacity)
    for n in reversed(large):
        while left[n]:
            at = bisect.bisect_right(large, min(capacity - n, n)) - 1
            while at >= 0 and not (left[large[at]] - (large[at] == n)):
                at -= 1
            if at < 0:
                open_gap(capacity - n, sequences, left[n])
                first, sequences = sequences, sequences + left[n]
                place(n, left[n], first, 1, 0)
                continue
            partner = large[at]
            many = left[n] // 2 if partner == n else min(left[n], left[partner])
            if partner == n:
                place(n, 2 * many, sequences, 2, 0)
            else:
                place(n, many, sequences, 1, 0)
                place(partner, many, sequences, 1, n)
            open_gap(capacity - n - partner, sequences, many)
            sequences += many
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect.bisect_left(order, n)
            if at == len(order):
                first, many, gap = sequences, -(-left[n] // (capacity // n)), capacity
                sequences += many
            else:
                gap = order[at]
                first, many = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[at]
            per = min(gap // n, left[n])
            full = min(many, left[n] // per)
            place(n, full * per, first, per, capacity - gap)
            open_gap(gap - per * n, first, full)
            open_gap(gap, first + full, many - full)
    return rows


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place: sequence_id and offset, gapless from 0 in each sequence.

    Null text counts as empty (its only token is ``end_id``); an empty table gives
    no rows; repeated rows are packed once for each row; ids may be null; other
    columns are not read, whatever their names.
    """
    found = materialise(pieces(docs, vocabulary, capacity, end_id, id_col, text_col, keep_ids), "pieces")
    histogram = {r[0]: r[1] for r in found.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = sorted(recipe(histogram, capacity))
    lengths, lows, _, firsts, pers, offsets = np.array(plan, dtype="i8").reshape(-1, 6).T
    keys = (lengths << 48) + lows

    deal = max(64, shuffle_partitions(docs.sparkSession))
    # copies of one document have one length and id: the deal also looks at the content, the ranks at all three
    dealt = found.withColumn("deal", F.pmod(F.xxhash64(F.col(id_col), "piece", "ids_crc32"), F.lit(deal)))
    sizes = dealt.groupBy("length", "deal").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "deal", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "deal").orderBy(F.col(id_col), "piece", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(within).cast("long")).join(bases, ["length", "deal"])
    ranked = ranked.select(*found.columns, (F.col("base") + F.col("rank") - 1).alias("rank"))
    schema = T.StructType([*found.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    at_length, at_rank = found.columns.index("length"), len(found.columns)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = batch.column(at_length).to_numpy(), batch.column(at_rank).to_numpy()
            at = np.searchsorted(keys, (n << 48) + rank, side="right") - 1
            i = rank - lows[at]
            place = [pa.array(firsts[at] + i // pers[at]), pa.array(offsets[at] + i % pers[at] * n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at_rank], *place], names=schema.names)

    return ranked.mapInArrow(locate, schema)
