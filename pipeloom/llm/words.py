"""Words and word n-gram hashes of whole Arrow text columns, computed with array operations.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D.  Its hash chains its
8-byte parts through a 64-bit finaliser, started from its length and a key, so no
two words collide by their structure; a long word is hashed as a whole.  An
n-gram's hash combines the hashes of its words.  Two keys give 128 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: Blocks of about so many bytes are hashed at a time; a block ends where no word is cut.
BLOCK = 1 << 20
#: Words of more bytes than this are hashed one by one.
LONG = 64
KEYS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


def _is_word() -> np.ndarray:
    table = np.ones(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def _folded() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


IS_WORD, FOLDED = _is_word(), _folded()


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets of the texts among them); null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(block: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int) -> np.ndarray:
    """Hash of each span of bytes."""
    padded = np.concatenate([block, np.zeros(8, np.uint8)])
    parts = np.ndarray((len(block) + 1,), np.dtype("<u8"), padded, 0, (1,))  # the 8 bytes from each place on
    size = ends - starts
    found = mix(size.astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(key))
    at, begin, left, h = None, starts, size, found
    while len(begin):
        part = parts[begin]
        short = left < 8
        part[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        h = mix((h ^ part) + np.uint64(key))
        if at is None:
            found = h
        else:
            found[at] = h
        more = np.flatnonzero((left > 8) & (left <= LONG) if at is None else left > 8)
        at = more if at is None else at[more]
        begin, left, h = begin[more] + 8, left[more] - 8, h[more]
    for k in np.flatnonzero(size > LONG).tolist():
        found[k] = xxhash.xxh3_64_intdigest(block[starts[k] : ends[k]].tobytes(), key)
    return found


def words(texts: pa.Array, fold: bool = False, keys: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words [keys, words], or [words] for one key; first[i] .. first[i + 1] = those of text i).  ``fold`` takes A-Z for a-z."""
    raw, offsets = text_buffer(texts)
    hashes, counts = [np.zeros((keys, 0), np.uint64)], np.zeros(len(texts) + 1, np.int64)
    lo = 0
    while lo < len(raw):
        hi = min(lo + BLOCK, len(raw))
        if hi < len(raw):
            hi = _safe_cut(raw, offsets, lo, hi)
        block = raw[lo:hi]
        word = IS_WORD[block]
        breaks = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi)] - lo
        before = np.empty_like(word)
        before[0] = False
        before[1:] = word[:-1]
        before[breaks] = False
        starts = np.flatnonzero(word & ~before)
        after = np.empty_like(word)
        after[-1] = False
        after[:-1] = word[1:]
        after[breaks[breaks > 0] - 1] = False
        ends = np.flatnonzero(word & ~after) + 1
        if fold:
            block = FOLDED[block]
        hashes.append(np.stack([spans(block, starts, ends, key) for key in KEYS[:keys]]))
        owner = np.searchsorted(offsets, starts + lo, side="right")
        counts += np.bincount(owner, minlength=len(counts))[: len(counts)]
        lo = hi
    found = np.concatenate(hashes, axis=1)
    return found[0] if keys == 1 else found, np.cumsum(counts)


def _safe_cut(raw: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> int:
    """The last place up to ``hi`` (else the first after it) where a text ends or a separator stands."""
    gaps = np.flatnonzero(~IS_WORD[raw[lo:hi]])
    text = int(offsets[np.searchsorted(offsets, hi, side="right") - 1])
    best = max(int(gaps[-1]) + lo + 1 if len(gaps) else lo, text)
    while best <= lo:
        at, hi = hi, min(hi + BLOCK, len(raw))
        gaps = np.flatnonzero(~IS_WORD[raw[at:hi]])
        later = offsets[(offsets > at) & (offsets <= hi)]
        found = [hi] if hi == len(raw) else []
        if len(gaps):
            found.append(int(gaps[0]) + at + 1)
        if len(later):
            found.append(int(later[0]))
        best = min(found, default=lo)
    return best


def multipliers(n: int, salt: int = 0) -> np.ndarray:
    """Odd factors, one per place in an n-gram."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(1000 * (salt + 1))) | np.uint64(1)


def ngrams(hashes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of the n words from each place on; places too near the end are absent."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for k, factor in enumerate(multipliers(n, salt)):
        total += hashes[k : k + len(total)] * factor
    return mix(total)
