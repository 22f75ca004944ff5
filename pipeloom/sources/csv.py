"""Strict CSV: NULL is an unquoted ``\\N``, an empty field is empty text, errors carry byte offsets.

A file is decoded on the executors: the quotes of each of its blocks are counted
first, which tells the line ends inside quotes from those of records, and the parts
of a record that goes from one block to the next are joined by the block where it
began.  Any doubt (an invalid record) sends the import to the sequential decoder,
which reads the file in pieces and either accepts it or names the offending byte.
Other failures of the job are not taken for a doubt.
"""

from __future__ import annotations

import datetime
import io
import itertools
import math
import re
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import row_type
from ..errors import InputError
from ..functions.constants import INT_MAX, INT_MIN
from .catalog import Catalog
from .store import opened

MAX_RECORD, MAX_FIELD = 8_388_801, 65_536
#: Bytes of a stream that are read at a time.
CHUNK = 1 << 20
_INT = re.compile(r"[+-]?[0-9]+")
_DOUBLE = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
_DATE = re.compile(r"([0-9]{4})-([0-9]{2})-([0-9]{2})")
#: An unquoted run, or the text of a quoted field with doubled quotes.
_PLAIN = re.compile(rb'[^",\r\n]*')
_QUOTED = re.compile(rb'"((?:[^"]|"")*)"')

Field = tuple[bytes | None, int]  # content (None: NULL), offset of the field


class More(Exception):
    """The buffer ends before the record does."""


def record(data: bytes, at: int, base: int, last: bool, record_limit: int, field_limit: int) -> tuple[list[Field], int, int]:
    """(fields, place of the record's end, place of the next) of the record at ``at`` of a buffer that begins at ``base`` of the input.

    Unless the buffer is the ``last`` one, ``More`` is raised where what follows it might matter.
    """
    start, fields, end = at, [], len(data)
    while True:
        begin = at
        if data[at : at + 1] == b'"':
            found = _QUOTED.match(data, at)
            if not last and (not found or found.end() == end or data[found.end()] == ord('"')):  # a quote may be the first of two
                raise More
            if not found:
                raise InputError("unterminated quoted field", base + end)
            content: bytes | None = found[1].replace(b'""', b'"')
            at = found.end()
        else:
            found = _PLAIN.match(data, at)
            at = found.end()
            content = None if found[0] == rb"\N" else found[0]
            if data[at : at + 1] == b'"':
                raise InputError("quote in an unquoted field", base + at)
        mark = data[at : at + 1]
        if not last and (not mark or mark == b"\r" and at + 1 == end):
            raise More
        if content is not None and len(content) > field_limit:
            raise InputError("field is too long", base + begin)
        fields.append((content, base + begin))
        if mark == b",":
            at += 1
            continue
        if mark == b"\r" and data[at + 1 : at + 2] != b"\n":
            raise InputError("bare carriage return", base + at)
        if mark not in (b"", b"\n", b"\r"):
            raise InputError("text after a closing quote", base + at)
        stop = at
        at += {b"": 0, b"\n": 1, b"\r": 2}[mark]
        if at - start > record_limit:
            raise InputError("record is too long", base + start)
        return fields, stop, at


def records(stream: BinaryIO, record_limit: int = MAX_RECORD, field_limit: int = MAX_FIELD) -> Iterator[tuple[list[Field], int, int]]:
    """(fields, offset of the record, offset of its end) of each record of a stream, which is read in pieces of ``CHUNK`` bytes.

    At most one record and a piece are at hand; a record that doesn't end within its
    limit is refused without being read on.
    """
    data, base, at, last = b"", 0, 0, False
    while True:
        if at == len(data) and last:
            return
        try:
            fields, stop, after = record(data, at, base, last, record_limit, field_limit)
        except More:
            if len(data) - at > 2 * record_limit + CHUNK:  # quotes may be doubled
                raise InputError("record is too long", base + at) from None
            more = stream.read(CHUNK)
            data, base, at, last = data[at:] + more, base + at, 0, not more
            continue
        yield fields, base + at, base + stop
        at = after


def cell(content: bytes | None, type_: str, nullable: bool, offset: int) -> object:
    if content is None:
        if not nullable:
            raise InputError("NULL in a required column", offset)
        return None
    try:
        text = content.decode()
    except UnicodeDecodeError as e:
        raise InputError("invalid UTF-8", offset + e.start) from None
    if type_ == "STRING":
        return text
    if type_ == "INT64" and _INT.fullmatch(text) and INT_MIN <= int(text) <= INT_MAX:
        return int(text)
    if type_ == "DOUBLE":
        if text in ("NaN", "Infinity", "-Infinity"):
            return float(text)
        if _DOUBLE.fullmatch(text) and math.isfinite(float(text)):
            return float(text)
    if type_ == "DATE" and (found := _DATE.fullmatch(text)):
        try:
            return datetime.date(*map(int, found.groups()))
        except ValueError:
            pass
    raise InputError(f"not a {type_} value", offset)


def decode(data: bytes | BinaryIO, columns: list[tuple[str, str, bool]], row_limit: int | None = None, record_limit: int = MAX_RECORD, field_limit: int = MAX_FIELD) -> Iterator[tuple]:
    """Rows in declaration order, decoded as they are asked for; the header names every column once, in any order and case."""
    found = records(io.BytesIO(data) if isinstance(data, bytes) else data, min(record_limit, MAX_RECORD), min(field_limit, MAX_FIELD))
    header = next(found, None)
    if header is None:
        raise InputError("missing header", 0)
    order = header_order(header[0], columns, header[2])
    rows = 0
    for fields, start, stop in found:
        if len(fields) != len(columns):
            raise InputError("wrong number of fields", fields[len(columns)][1] if len(fields) > len(columns) else stop)
        rows += 1
        if row_limit is not None and rows > row_limit:
            raise InputError("row limit exceeded", start)
        row: list[object] = [None] * len(columns)
        for k, (content, offset) in zip(order, fields, strict=True):
            row[k] = cell(content, columns[k][1], columns[k][2], offset)
        yield tuple(row)
    if not rows:
        raise InputError("no data rows", 0)


class CsvDecoder:
    """Batches of decoded rows from a binary stream; errors are terminal, earlier batches are only a valid prefix."""

    def __init__(self, stream: BinaryIO, columns: list[tuple[str, str, bool]], batch_rows: int = 256, row_limit: int | None = None):
        self.rows, self.batch_rows, self.failed = decode(stream, columns, row_limit), batch_rows, False

    def next_batch(self) -> list[tuple] | None:
        """The next rows, or None at the end."""
        if self.failed:
            raise InputError("the decoder failed before")
        try:
            batch = list(itertools.islice(self.rows, self.batch_rows))
        except InputError:
            self.failed = True
            raise
        return batch or None


#: How a doubt of an executor is known from other failures of a job.
DOUBT = "pipeloom: a record is not valid"


class Doubt(Exception):
    """A record that the parallel decoder doesn't decide."""


def header_order(header: list[Field], columns: list[tuple[str, str, bool]], stop: int) -> list[int]:
    """For each header field, its column's place in the declaration."""
    place = {name.lower(): k for k, (name, _, _) in enumerate(columns)}
    order: list[int] = []
    for content, offset in header:
        name = (content if content is not None else b"\\N").decode("utf-8", "replace").lower()
        if name not in place or place[name] in order:
            raise InputError("unknown or repeated column", offset)
        order.append(place[name])
    if len(order) != len(columns):
        raise InputError("missing column", stop)
    return order


def block_states(lines: DataFrame) -> dict[int, tuple[bool, int]]:
    """For each block of a file, by its offset: whether its first line goes on inside quotes, and the block where that record began.

    In a valid file a line end is inside quotes if the quotes before it are odd in
    number, so the numbers of lines with an odd number of them tell all.  One row a
    block reaches the driver.
    """
    quotes = F.octet_length("text") - F.octet_length(F.replace("text", F.lit('"'), F.lit("")))
    found = lines.groupBy("at").agg(F.sum(quotes % 2), F.max("length")).collect()
    states: dict[int, tuple[bool, int]] = {}
    inside, owner, owner_end = False, 0, 0
    for at, odd, length in sorted(found):
        states[at] = (inside, owner)
        if inside and at - owner_end > MAX_RECORD:
            raise Doubt
        if not inside or odd:  # a record that is open at this block's end began in it
            owner, owner_end = at, at + length
        inside ^= odd % 2 == 1
    if inside:
        raise Doubt
    return states


def pieces(lines: Iterable[tuple[bytes, int]], states: dict[int, tuple[bool, int]]) -> Iterator[tuple[int, int, bytes, bool]]:
    """(block where the record began, own block, bytes, whether they are a whole record) of lines in file order; the header is left out."""
    block, owner, inside, whole = -1, 0, False, True
    held: list[bytes] = []
    size = 0
    for line, at in lines:
        if at != block:
            if held:
                yield owner, block, b"".join(held), False
            block, held, size = at, [], 0
            inside, owner = states[at]
            whole = not inside
            if at == 0:
                owner = 0
                continue
        if not held and whole:
            owner = at
        held.append(line + b"\n")
        size += len(line) + 1
        if size > MAX_RECORD + 1:
            raise Doubt(DOUBT)
        inside ^= line.count(b'"') % 2 == 1
        if not inside:
            yield owner, at, b"".join(held), whole
            held, size, whole = [], 0, True
    if held:
        yield owner, block, b"".join(held), False


def parallel_rows(catalog: Catalog, columns: list[tuple[str, str, bool]], path: str) -> DataFrame:
    """The typed rows of a file, decoded by the executors; ``Doubt``, at once or when it is read, where the file may be invalid."""
    text = catalog.spark.read.text(path, lineSep="\n").select(F.col("value").alias("text"), F.col("_metadata.file_block_start").alias("at"), F.col("_metadata.file_block_length").alias("length"))
    lines = text.select(F.col("text").cast("binary").alias("line"), "at")
    first = lines.where("at = 0").limit(1).collect()
    if not first:
        raise Doubt
    try:
        ((header, _, stop),) = records(io.BytesIO(bytes(first[0][0]) + b"\n"))
    except (InputError, ValueError) as e:
        raise Doubt from e
    order = header_order(header, columns, stop)
    schema = row_type(columns)
    arrow = [{"INT64": pa.int64(), "DOUBLE": pa.float64(), "STRING": pa.string(), "DATE": pa.date32()}[t] for _, t, _ in columns]
    states = block_states(text)

    def typed(found: Iterable[bytes]) -> Iterator[pa.RecordBatch]:
        """The rows of whole records, a batch for each ``CHUNK`` bytes or so."""
        rows: list[list] = [[] for _ in columns]
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, arrow, strict=True)], names=[n for n, _, _ in columns])

        for data in found:
            try:
                fields, _, after = record(data, 0, 0, True, MAX_RECORD, MAX_FIELD)
                if len(fields) != len(columns) or after != len(data):
                    raise Doubt(DOUBT)
                for k, (content, offset) in zip(order, fields, strict=True):
                    rows[k].append(cell(content, columns[k][1], columns[k][2], offset))
            except (InputError, ValueError) as e:
                raise Doubt(DOUBT) from e
            size += len(data)
            if size >= CHUNK:
                yield batch()
                rows, size = [[] for _ in columns], 0
        yield batch()

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, int]]:
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from typed(data for _, _, data, whole in pieces(in_order(batches), states) if whole)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for owner, at, data, whole in pieces(in_order(batches), states):
            if not whole:
                yield pa.RecordBatch.from_arrays([pa.array([owner], pa.int64()), pa.array([at], pa.int64()), pa.array([data], pa.binary())], names=["owner", "at", "data"])

    def joined(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(typed([b"".join(table.sort_by("at").column("data").to_pylist())]))

    rows = lines.mapInArrow(decoded, schema)
    if not any(inside for inside, _ in states.values()):
        return rows
    # records that go from one block to the next: their parts meet by the block where they began
    return rows.union(lines.mapInArrow(parts, "owner long, at long, data binary").groupBy("owner").applyInArrow(joined, schema))


def import_csv_file(catalog: Catalog, table: str, path: str, input_limit: int | None = None, row_limit: int | None = None, **limits: int) -> tuple[int, int, str]:
    """Append one complete CSV file: (generation, rows, token).  Limits, or doubt, make the decoding sequential."""
    if input_limit is None and row_limit is None and not limits:
        append = catalog.begin_append(table)
        try:
            append.write_dataframe(parallel_rows(catalog, list(append.schema.columns), path))
            rows = append.written().count()
            if rows:
                return append.commit(), rows, append.token
        except Doubt:
            pass
        except Exception as e:
            if DOUBT not in str(e):
                raise
        finally:
            append.abort()  # nothing to do after a commit
    with opened(catalog.spark, path) as stream:
        return import_csv(catalog, table, stream, input_limit, row_limit, **limits)


class Limited(io.RawIOBase):
    """A stream that fails where it goes beyond ``limit`` bytes."""

    def __init__(self, stream: BinaryIO, limit: int):
        self.stream, self.limit, self.seen = stream, limit, 0

    def read(self, size: int = -1) -> bytes:
        data = self.stream.read(size)
        self.seen += len(data)
        if self.seen > self.limit:
            raise InputError("input limit exceeded", self.limit)
        return data


def import_csv(catalog: Catalog, table: str, stream: BinaryIO, input_limit: int | None = None, row_limit: int | None = None, **limits: int) -> tuple[int, int, str]:
    """Append one complete CSV input, read and written in bounded pieces: (generation, rows, token).  Any failure commits nothing.

    ``limits`` may give record_limit (encoded bytes) and field_limit (decoded bytes).
    """
    append = catalog.begin_append(table)
    rows = 0

    def counted(found: Iterator[tuple]) -> Iterator[tuple]:
        nonlocal rows
        for row in found:
            rows += 1
            yield row

    try:
        source = stream if input_limit is None else Limited(stream, input_limit)
        append.write(counted(decode(source, list(append.schema.columns), row_limit, **limits)))
        return append.commit(), rows, append.token
    except BaseException:
        append.abort()
        raise
