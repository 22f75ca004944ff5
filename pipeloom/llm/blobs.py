"""Packed lists of occurrences, the unit that the exact-repeat operators shuffle.

Sending one row per occurrence of a hash costs far more than the occurrence.
Instead each batch of documents sorts its occurrences by hash, keeps one for each
hash (so a hash that is everywhere is sent once a batch, not once an occurrence)
and sends, for each range of hashes, one row with the packed list.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import zstandard

#: Column types of an occurrence: its hash in 64 or 128 bits, its document's id, its place there, and a flag.
SHORT = (("h", np.uint64), ("doc", np.int64), ("pos", np.int32), ("flag", np.uint8))
OCCURRENCE = (("h", np.uint64), ("g", np.uint64), ("doc", np.int64), ("pos", np.int32), ("flag", np.uint8))
#: A repeated place, its class, and whether the class occurs earlier.
PLACE = (("doc", np.int64), ("pos", np.int32), ("h", np.uint64), ("flag", np.uint8))


#: Columns that are stored as differences: they compress well where the rows are sorted by them.
STEPS = ("doc", "pos")


def pack(columns: dict[str, np.ndarray], kinds: tuple) -> bytes:
    """Columns of equal length, as planes of bytes (like bytes together), compressed."""
    n = len(columns[kinds[0][0]])
    planes = []
    for name, kind in kinds:
        column = columns[name].astype(kind)
        if name in STEPS and n:
            column = np.concatenate([column[:1], column[1:] - column[:-1]])  # modulo the type's size
        planes.append(np.ascontiguousarray(column.view(np.uint8).reshape(n, -1).T).tobytes())
    return zstandard.compress(n.to_bytes(8, "little") + b"".join(planes), 1)


def unpack(blobs: list[bytes], kinds: tuple) -> dict[str, np.ndarray]:
    parts: dict[str, list[np.ndarray]] = {name: [np.zeros(0, kind)] for name, kind in kinds}
    for blob in blobs:
        data = zstandard.decompress(blob)
        n, at = int.from_bytes(data[:8], "little"), 8
        for name, kind in kinds:
            size = np.dtype(kind).itemsize
            planes = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n)
            column = np.ascontiguousarray(planes.T).view(kind).reshape(-1)
            parts[name].append(np.cumsum(column, dtype=kind) if name in STEPS else column)
            at += n * size
    return {name: np.concatenate(p) for name, p in parts.items()}


def take(columns: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
    return {name: c[at] for name, c in columns.items()}


def concat(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}


def by_hash(columns: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The columns sorted by (hash, document, place), equal ones once, and True where a new hash begins."""
    names = [c for c in ("h", "g") if c in columns]
    at = np.lexsort((columns["pos"], columns["doc"], *(columns[c] for c in reversed(names))))
    columns = take(columns, at)
    new = np.ones(len(at), bool)
    new[1:] = np.any([columns[c][1:] != columns[c][:-1] for c in names], axis=0)
    own = new.copy()
    own[1:] |= (columns["doc"][1:] != columns["doc"][:-1]) | (columns["pos"][1:] != columns["pos"][:-1])
    if own.all():
        return columns, new
    starts = np.flatnonzero(own)
    once = take(columns, starts)
    once["flag"] = np.maximum.reduceat(columns["flag"], starts)
    return once, new[starts]


def group_of(doc: np.ndarray, groups: int) -> np.ndarray:
    """Which group a document's id is dealt to; equals :func:`group_column`."""
    x = (doc.astype(np.uint64) ^ (doc.astype(np.uint64) >> np.uint64(32))) & np.uint64(0x7FFFFFFF)
    return ((x * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)) >> np.uint64(7)).astype(np.int64) % groups


def split(columns: dict[str, np.ndarray], key: np.ndarray, kinds: tuple, by: tuple = ()) -> list[tuple[int, bytes]]:
    """(key, packed columns) for each key, sorted by the columns ``by``."""
    order = np.lexsort((*(columns[c] for c in reversed(by)), key)) if by else np.argsort(key, kind="stable")
    columns, key = take(columns, order), key[order]
    bounds = np.flatnonzero(np.diff(key, prepend=key[0] - 1 if len(key) else 0, append=key[-1] + 1 if len(key) else 0))
    return [(int(key[a]), pack({n: c[a:b] for n, c in columns.items()}, kinds)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def tidy() -> None:
    """Give memory that a task is done with back to the system; a Python worker lives on and would hold it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)
