"""Subword token ids of whole texts, as the tokenizers library gives them.

A byte-level BPE file holds a vocabulary and merges in order of rank.  Where the
ids of merged tokens rise with the merges' rank, and the split pattern is the one
below, the same ids follow from the vocabulary alone, which tiktoken applies
several times faster.  Files of another kind, and texts that hold a special token's
string, go to the library itself.
"""

from __future__ import annotations

import json

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Fixed value: the split pattern of a byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: printable bytes for themselves, the others by letters from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def ranks(model: dict) -> dict[bytes, int] | None:
    """Token bytes -> id if the ids alone give the merges' order, else None."""
    pre = model.get("pre_tokenizer") or {}
    core = model["model"]
    plain = model.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    if not plain or core["type"] != "BPE" or core.get("dropout") or core.get("ignore_merges"):
        return None
    special = {t["content"] for t in model.get("added_tokens", [])}
    vocab = {t: k for t, k in core["vocab"].items() if t not in special}
    letters = byte_letters()
    merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in core["merges"]]
    if None in merged or any(b <= a for a, b in zip(merged, merged[1:], strict=False)) or any(c not in letters for t in vocab for c in t):
        return None
    return {bytes(letters[c] for c in t): k for t, k in vocab.items()}


class Encoder:
    """``ids(text)`` equals ``Tokenizer.encode(text, add_special_tokens=False).ids``, as bytes of uint32."""

    def __init__(self, path: str):
        self.path, self._library = path, None
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.special = [t["content"] for t in model.get("added_tokens", [])]
        found = ranks(model)
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=found, special_tokens={}) if found else None

    @property
    def library(self) -> Tokenizer:
        """Loaded only when a text needs it."""
        if self._library is None:
            self._library = Tokenizer.from_file(self.path)
        return self._library

    def ids(self, text: str) -> bytes:
        if self.fast is None or any(mark in text for mark in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary file and worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
