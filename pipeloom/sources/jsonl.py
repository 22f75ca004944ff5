"""Typed JSON Lines: a schema record, one record a row, and a completion record."""

from __future__ import annotations

import datetime
import json
import struct
from typing import TextIO

from ..engine import Prepared
from ..errors import ResourceError

FORMAT, VERSION = "pipeloom-jsonl", 1


def cell(value: object) -> str | None:
    """INT64 as decimal text, DOUBLE as 16 hexadecimal digits of its bits, DATE in ISO form."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, float):
        return struct.pack(">d", value).hex()
    return value.isoformat() if isinstance(value, datetime.date) else str(value)


def dump(record: object) -> str:
    return json.dumps(record, separators=(",", ":"), ensure_ascii=False) + "\n"


def export_jsonl(prepared: Prepared, out: TextIO, row_limit: int | None = None, byte_limit: int | None = None) -> int:
    """Write the complete result; the number of rows.  Without the completion record a file isn't complete."""
    written = rows = 0

    def put(record: object) -> None:
        nonlocal written
        line = dump(record)
        written += len(line.encode())
        if byte_limit is not None and written > byte_limit:
            raise ResourceError("output bytes", written, byte_limit)
        out.write(line)

    columns = [{"name": name, "type": type_.lower(), "nullable": nullable} for name, type_, nullable in prepared.columns]
    put({"format": FORMAT, "version": VERSION, "columns": columns})
    for batch in prepared.batches():
        for row in batch:
            rows += 1
            if row_limit is not None and rows > row_limit:
                raise ResourceError("output rows", rows, row_limit)
            put({"row": [cell(v) for v in row]})
    put({"complete": True, "rows": rows})
    out.flush()
    return rows
