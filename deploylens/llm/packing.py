"""Packing token sequences into rows of fixed length: length patterns fitted by non-negative least squares.

The histogram of piece lengths (as many bins as a sequence has tokens, whatever the corpus) is all
the driver sees. Patterns of up to three lengths that fill a sequence exactly are enumerated, their
repeat counts fitted to the histogram by non-negative least squares and rounded; what the rounding
leaves is packed by best fit on the histogram, longest first, a whole run of equal sequences at a time.
Each pattern's slots are then intervals of ranks within a length, so every piece finds its sequence
from its own rank. Ranks are counted within salted parts of a length, so a length that many copies
share is no single task's work.

Nulls count as empty texts, which still have the closing id. Repeated rows are packed each.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import re
import struct
import unicodedata
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import common

CAPACITY = 2048
#: Distance between the second lengths of the enumerated three-document patterns.
PATTERN_STEP = 64
#: Rows of one length that one task ranks at most, about.
RANKED_ROWS = 3000
MEMO_PARTS = 400_000

# tokens --------------------------------------------------------------------------------------


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Memo(dict):
    """What ``made`` gives for a key, remembered for keys of up to 64 characters; started anew when full."""

    def __init__(self, made: Callable[[str], bytes]):
        self.made = made

    def __missing__(self, key: str) -> bytes:
        found = self.made(key)
        if len(key) <= 64:
            if len(self) >= MEMO_PARTS:
                self.clear()
            self[key] = found
        return found


class WordTokens:
    """Ids of whole texts by a word-level tokenizer file, remembered by word.

    No token reaches across white space, so a text is the sum of its words."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.merged = self.tokenizer.model.tokenize
        self.memo, self.small = Memo(self.word), Memo(self.part)
        self.pretokens = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.ascii_pretokens = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+").findall  # the same for lower-case ASCII
        self.latin = regex.compile("[!-~¡-¬®-ɏ]+").fullmatch
        self.printable = re.compile("[!-~]+").fullmatch
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)").search
        self.spelt = any(t.isascii() and t.isalpha() for t in special)
        # the printable stand-ins of byte-level models: visible Latin-1 as it is, the rest from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.stand_in = {**{b: b for b in shown}, **{b: 256 + k for k, b in enumerate(hidden)}}

    def part(self, part: str) -> bytes:
        plain = part if part.isascii() else part.encode("utf-8").decode("latin-1").translate(self.stand_in)
        return packed([t.id for t in self.merged(plain)])

    def word(self, word: str) -> bytes:
        """Latin words are split here and remembered by part; any other goes to the tokenizer whole."""
        if word.isascii():
            if word.isalpha() and not self.spelt:
                return self.small[word.lower()]
            if not word:
                return b""
            if self.printable(word) and not self.special(word):
                return b"".join(map(self.small.__getitem__, self.ascii_pretokens(word.lower())))
        elif self.latin(word) and not self.special(word) and unicodedata.is_normalized("NFC", word):
            return b"".join(map(self.small.__getitem__, self.pretokens(word.lower())))
        return packed(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def ids(self, text: str) -> bytes:
        """All ids of the text as little-endian 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, text.replace("\n", " ").replace("\t", " ").split(" ")))


def word_tokens(path: str) -> WordTokens:
    held = common.kept(__name__)
    if path not in held:
        held[path] = WordTokens(path)
    return held[path]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Per piece of a document: doc_id, piece, start, length, ids_crc32 (and ids, if kept). A document is its
    ids and a closing 0; only a document longer than ``capacity`` is cut."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        t, rows = word_tokens(path), []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), common.texts(batch), strict=True):
            data = t.ids(text) + b"\0\0\0\0"
            for k, at in enumerate(range(0, len(data), 4 * capacity)):
                own = data[at : at + 4 * capacity]
                rows.append((doc_id, k, at // 4, len(own) // 4, zlib.crc32(own), np.frombuffer(own, "<i4") if keep_ids else None))
        cols = list(zip(*rows, strict=True))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
        names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")[: 5 + keep_ids]
        return pa.RecordBatch.from_arrays([pa.array(cols[i], kinds[i]) for i in range(len(names))], list(names))

    return common.map_batches(common.doc_texts(docs), fn, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


# patterns ------------------------------------------------------------------------------------


def enumerate_patterns(capacity: int = CAPACITY, step: int = PATTERN_STEP) -> np.ndarray:
    """Rows of three ascending lengths (0: none) that sum to ``capacity``: all of one and two documents,
    and of three documents those whose middle length lies on a grid that shifts with the shortest."""
    rows = [(0, 0, capacity)] + [(0, a, capacity - a) for a in range(1, capacity // 2 + 1)]
    for a in range(1, capacity // 3 + 1):
        rows += [(a, b, capacity - a - b) for b in range(a + a * 7 % step, (capacity - a) // 2 + 1, step)]
    return np.array(rows, np.int64)


def fit_repeats(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the squared difference between the pieces the patterns use and
    ``histogram`` (by length; longer pieces weigh more, as they are harder to place later), by
    accelerated projected gradient."""
    n = len(histogram)
    weight = 0.09 + 0.91 * np.arange(n) / (n - 1)
    weight[0] = 0.0  # the empty slot of shorter patterns
    used = lambda x: sum(np.bincount(patterns[:, j], x, n) for j in range(3))
    back = lambda r: sum(r[patterns[:, j]] for j in range(3))
    v = np.ones(len(patterns))
    for _ in range(30):
        v = back(weight**2 * used(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(weight**2 * (used(y) - histogram)) / (1.05 * top))
        t, last = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        x, y = new, new + (last - 1) / t * (new - x)
    return x


def plan(histogram: np.ndarray) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, how many such sequences) that use each piece of the histogram exactly once."""
    capacity, left, out = len(histogram) - 1, histogram.astype(np.int64).copy(), []
    patterns = enumerate_patterns(capacity)
    repeats = fit_repeats(patterns, left.astype(float))
    for k in np.argsort(-repeats, kind="stable"):
        r = round(repeats[k])
        if r < 1:
            break
        own = [int(n) for n in patterns[k] if n][::-1]
        r = min(r, *(int(left[n]) // own.count(n) for n in own))
        if r > 0:
            for n in own:
                left[n] -= r
            out.append((own, r))
    lengths = [int(n) for n in np.flatnonzero(left)]
    while lengths:
        own, gap, used = [], capacity, {}
        at = len(lengths) - 1
        while at >= 0:
            n = lengths[at]
            if used.get(n, 0) < left[n]:
                own.append(n)
                gap -= n
                used[n] = used.get(n, 0) + 1
                at = min(at, bisect.bisect_right(lengths, gap) - 1)
            else:
                at -= 1
        r = min(int(left[n]) // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= r * k
            if not left[n]:
                del lengths[bisect.bisect_left(lengths, n)]
        out.append((own, r))
    return out


def slots(planned: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """By length: rows of (first rank, first sequence, offset), in order of rank; a slot runs to the next one's rank."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for own, r in planned:
        offset = 0
        for n in own:
            found.setdefault(n, []).append((rank.get(n, 0), sequence, offset))
            rank[n] = rank.get(n, 0) + r
            offset += n
        sequence += r
    return {n: np.array(x, np.int64) for n, x in found.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, length and more) with sequence_id and offset."""
    pieces = common.checkpointed(pieces)
    counted = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    histogram = np.zeros(capacity + 1, np.int64)
    for n, k in counted.items():
        histogram[n] = k
    by_length = slots(plan(histogram)) if counted else {}
    parts = max(1, math.ceil(max(counted.values(), default=0) / RANKED_ROWS))
    crowded = [n for n, k in counted.items() if k > RANKED_ROWS]  # the other lengths stay whole
    part = F.when(F.col("length").isin(crowded), F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts))).otherwise(0)
    salted = pieces.withColumn("part", part.cast("int"))
    before = salted.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = before.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece"))
    ranked = salted.withColumn("within", within).join(before, ["length", "part"])
    ranked = ranked.select(*pieces.columns, (F.col("before") + F.col("within") - 1).alias("rank"))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for n in np.unique(length):
            own, at = by_length[int(n)], np.flatnonzero(length == n)
            k = np.searchsorted(own[:, 0], rank[at], "right") - 1
            sequence[at], offset[at] = own[k, 1] + rank[at] - own[k, 0], own[k, 2]
        names = [c for c in batch.schema.names if c != "rank"]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"{c} {t}" for c, t in pieces.dtypes)
    return common.map_batches(ranked, fn, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if kept)."""
    return pack(token_pieces(docs, path, capacity, keep_ids), capacity)
