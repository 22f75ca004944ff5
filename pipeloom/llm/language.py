"""Language identification by cross-parsing entropy (operator 4).

For each language a suffix automaton of labelled text is built.  A text is parsed
greedily into phrases, each the longest match of what comes next with anything in
that language's training text; a symbol that the training text lacks is a phrase of
its own.  Few phrases mean text like the training text: phrases x log2(longest
training length) / length of the text estimates the cross entropy in bits a symbol,
and the language with the least wins.  A phrase costs the same in every language:
were it cheaper with little training text, a sample of a few bytes would win nearly
every document with a phrase for each byte.  All samples are cut to equal bounds.

Parsing runs over whole texts in lockstep: texts are cut into stretches of
``STRETCH`` symbols, where a phrase ends too, every stretch and language is one lane,
and a step moves all lanes by one symbol through a transition table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh

UNDETERMINED = "und"
#: Bounds of the training sample, which is fitted on passages drawn from whole labelled texts: symbols of a language, its passages, characters of a passage.
TRAIN_BYTES, TRAIN_ROWS, TRAIN_CHARS = 40_000, 200, 1_000
#: Symbols of all languages together (each gets an equal share, up to TRAIN_BYTES), which bounds a worker's tables, and the least share: so at most 6,250 languages.
TRAIN_TOTAL, LEAST_SHARE = 400_000, 64
STRETCH, LANES = 4_096, 4_096
#: Symbols of text at hand at a time, over all languages.
AT_HAND = 16_000_000


def classes() -> np.ndarray:
    """Class of each byte: 0 separator, 1-26 letters of either case, then one per byte from 128 on."""
    table = np.zeros(256, np.uint8)
    for k in range(26):
        table[ord("a") + k] = table[ord("A") + k] = 1 + k
    table[128:] = 27 + np.arange(128)
    return table


CLASSES, WIDTH = classes(), 155


def normalise(text: str) -> np.ndarray:
    """Byte classes with runs of separators made one and none at the ends."""
    if not text.isascii():
        text = text.lower()
    codes = CLASSES[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    keep = codes > 0
    keep[1:] |= codes[:-1] > 0
    codes = codes[keep]
    return codes[:-1] if len(codes) and codes[-1] == 0 else codes


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts every substring; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for code in codes:
        now = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and code not in moves[at]:
            moves[at][code] = now
            at = link[at]
        if at >= 0:
            to = moves[at][code]
            if length[to] == length[at] + 1:
                link[now] = to
            else:
                twin = len(moves)
                moves.append(dict(moves[to]))
                link.append(link[to])
                length.append(length[at] + 1)
                while at >= 0 and moves[at].get(code) == to:
                    moves[at][code] = twin
                    at = link[at]
                link[to] = link[now] = twin
        last = now
    return moves


class Parser:
    """The automata of all languages as one table.

    An entry is the next state's place in the table; where a phrase begins with the
    symbol it is the bitwise complement of that place.
    """

    def __init__(self, samples: list[tuple[str, bytes]]):
        samples = [(name, sample) for name, sample in samples if any(sample)]
        self.languages = [name for name, _ in samples]
        used = sorted({c for _, s in samples for c in s})
        self.alphabet = np.full(256, len(used), np.int64)  # the last symbol: in no sample
        self.alphabet[used] = np.arange(len(used))
        self.width = width = len(used) + 1
        self.bits = np.log2(max([2, *(len(s) for _, s in samples)]))
        automata = [suffix_automaton([int(c) for c in self.alphabet[np.frombuffer(sample, np.uint8)]]) for _, sample in samples]
        size = sum(map(len, automata)) * width
        kind = np.int32 if size < 2**31 else np.int64
        parts, self.starts, base = [], [], 0
        for moves in automata:
            begun = np.full(width, ~(base * width), kind)  # a symbol that no text of the language has: back to the start after it
            for code, to in moves[0].items():
                begun[code] = ~((base + to) * width)
            table = np.tile(begun, (len(moves), 1))
            for state, out in enumerate(moves[1:], 1):
                for code, to in out.items():
                    table[state, code] = (base + to) * width
            parts.append(table.reshape(-1))
            self.starts.append(base * width)
            base += len(moves)
        self.table = np.concatenate(parts) if parts else np.zeros(0, kind)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Number of phrases of each text in each language, [texts, languages]."""
        total = np.zeros((len(texts), len(self.languages)), np.int64)
        counts = [-(-len(t) // STRETCH) for t in texts]
        owner = np.repeat(np.arange(len(texts)), counts)
        if not len(owner) or not self.languages:
            return total
        size = np.array([len(t) for t in texts])
        first = np.cumsum(counts) - counts
        within = np.arange(len(owner)) - np.repeat(first, counts)
        lens = np.minimum(STRETCH, size[owner] - within * STRETCH)
        flat = self.alphabet[np.concatenate(texts)]
        begin = np.repeat(np.cumsum(size) - size, counts) + within * STRETCH
        order = np.argsort(-lens, kind="stable")
        found = np.empty((len(owner), len(self.languages)), np.int64)
        for lo in range(0, len(order), LANES):
            lanes = order[lo : lo + LANES]
            n, at = lens[lanes], begin[lanes]
            state = np.tile(np.array(self.starts, np.int64)[:, None], (1, len(lanes)))
            begun = np.zeros((len(self.languages), len(lanes)), np.int64)
            live = len(lanes)
            for step in range(int(n[0])):
                while n[live - 1] <= step:
                    live -= 1
                to = self.table[state[:, :live] + flat[at[:live] + step]]
                new = to < 0
                begun[:, :live] += new
                state[:, :live] = np.where(new, ~to, to)
            found[lanes] = begun.T
        np.add.at(total, owner, found)
        return total


_parsers: dict[int, Parser] = {}


def parser_of(samples: list[tuple[str, bytes]]) -> Parser:
    """Built once for each training sample and worker process."""
    key = hash(tuple(samples))
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = Parser(samples)
    return _parsers[key]


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", train_bytes: int = TRAIN_BYTES, train_rows: int = TRAIN_ROWS, train_chars: int = TRAIN_CHARS, train_total: int = TRAIN_TOTAL) -> list[tuple[str, bytes]]:
    """The bounded training sample: per language, name and symbols.

    Whole labelled texts are cut into passages of ``train_chars`` characters; of each
    language's distinct passages the first ``train_rows`` in a hash order are joined
    and cut to an equal share of ``train_total``, ``train_bytes`` at most.  So copies
    count once and every part of every text may be drawn.  Only training is bounded so;
    prediction reads whole texts.  A language whose texts have no letters has no
    sample; one with little text has a small one and wins only what it matches best.
    Of more than ``train_total / LEAST_SHARE`` languages those with the most passages
    are learnt.  Null labels and texts are left out; an empty table gives no samples.
    """
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) > 0))
    passages = F.regexp_extract_all(F.col(text_col), F.lit(f"(?s).{{1,{train_chars}}}"), F.lit(0))
    rows = usable.select(F.col(lang_col).cast("string").alias("l"), F.explode(passages).alias("t")).withColumn("k", F.xxhash64("t"))
    counted = rows.groupBy("l").agg(F.approx_count_distinct("k").alias("n_texts"))
    counts = counted.orderBy(F.desc("n_texts"), "l").limit(max(1, train_total // LEAST_SHARE)).collect()
    share = min(train_bytes, train_total // max(1, len(counts)))
    # of each language about 4 x as many passages as are used, whatever the corpus size and the number of copies; the first ones are among them
    wanted = 4 * min(train_rows, -(-share * 8 // train_chars) + 8)
    limits = docs.sparkSession.createDataFrame([(lang, min(2**63 - 1, -(2**63) + 2**64 * wanted // max(1, n))) for lang, n in counts], "l string, last long")
    drawn = rows.join(F.broadcast(limits), "l").where("k <= last").select("l", "k", "t").distinct()  # at most train_total / LEAST_SHARE limits
    texts: dict[str, list[tuple[int, str]]] = {lang: [] for lang, _ in counts}
    for lang, k, text in drawn.collect():
        texts[lang].append((k, text))
    samples = []
    for lang in sorted(texts):
        data = b"".join(normalise(text).tobytes() + b"\0" for _, text in sorted(texts[lang])[:train_rows])[:share]
        if any(data):
            samples.append((lang, data))
    return samples


def identify(docs: DataFrame, samples: list[tuple[str, bytes]], text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus lang_pred and score (0 to 1: how far the runner-up's entropy is above the winner's).

    Null text, text without letters and an empty training sample give ``und`` with
    score 0.  A language whose own sample is empty never wins.  Ties go to the
    language first in name order.  Only the text is looked at, so repeated rows get
    equal results; an empty table gives no rows.  Where ``docs`` has columns of these
    names the new ones get underscores.
    """
    name, score = fresh(docs, "lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StringType()), T.StructField(score, T.DoubleType())])
    at = docs.columns.index(text_col)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = parser_of(samples)
        for batch in batches:
            names: list[str] = []
            scores: list[float] = []
            column, lo = batch.column(at), 0
            while lo < len(batch):
                texts, mass, hi = [], 0, lo
                while hi < len(batch) and mass * max(1, len(parser.languages)) < AT_HAND:
                    text = column[hi].as_py()
                    texts.append(normalise(text) if text and any(map(str.isalpha, text)) else np.zeros(0, np.uint8))
                    mass += len(texts[-1])
                    hi += 1
                bits = parser.phrases(texts) * parser.bits
                for text, row in zip(texts, bits, strict=True):
                    if not len(text) or not len(row):
                        names.append(UNDETERMINED)
                        scores.append(0.0)
                        continue
                    best = int(np.argmin(row))
                    rest = np.delete(row, best)
                    names.append(parser.languages[best])
                    scores.append(float(1 - row[best] / rest.min()) if len(rest) else 1.0)
                lo = hi
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return docs.mapInArrow(predict, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that training never sees: crc32 of the id's text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
