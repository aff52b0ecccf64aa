"""Packing token sequences in the order of the documents: windows cut by dynamic programming at document and sentence ends.

The documents of a partition are one stream of ids, in the order of their rows, and each sequence is a window of it. The cost of a window is its padding:
a window is padded to ``CAPACITY``, unless its length is a power of two. A cut within a document costs a truncation
penalty on top, a small one at a sentence end and a larger one elsewhere; other places are offered only where sentence ends are far apart. Places are taken in ascending order;
the best way to end a window there comes from the places one window back at most: of those, a monotone queue keeps the one from which padding is
cheapest, and the places exactly a power of two back are looked up. So a place takes constant time on average.

A task cuts what it has read as soon as that is ``STREAM`` ids, hands out all windows but the last, and goes on from there, so it holds a bounded
number of ids besides one document. Nothing is shuffled: sort the documents before if another order than the table's is wanted. A partition's last window
is the only one that lacks followers.

Null texts count as empty, and an empty text still has its closing id. Repeated rows are packed each. Very long texts are tokenised whole and cut
over as many windows as they need. Rows with a null doc_id are packed too. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import array
import json
import re
import zlib
from collections import deque
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from . import common

CAPACITY, CLOSING = 2048, 1
#: What a cut within a document costs, in ids of padding: at a sentence end, and elsewhere.
SENTENCE_PENALTY, INSIDE_PENALTY = 8, 32
#: What a window costs besides, so that of equally good ways the one with fewer windows is taken, and windows of a few ids are no gain.
WINDOW_COST = 2
#: Ids between places within a sentence.
STRIDE = 128
#: Ids that are cut at once.
STREAM = 1 << 19
#: Pieces whose ids a worker keeps, some 200 bytes each.
MEMO_PIECES = 2_000_000

# tokens --------------------------------------------------------------------------------------


class Pieces(dict):
    """Ids by piece, each made when it is first met. ``lead`` stands before every piece."""

    def __init__(self, tokens: ByteTokens, lead: str):
        self.tokens, self.merged, self.lead = tokens, tokens.merged, lead

    def __missing__(self, piece: str) -> bytes:
        keep = len(piece) <= 64
        if piece.isalpha() and (piece.isascii() or self.tokens.latin(piece)):
            found = array.array("I", self.merged((self.lead + piece).encode())).tobytes()
        elif (sign := self.tokens.signs.get(piece[-1:])) is not None and piece[:-1].isalpha():
            word = piece[:-1]  # no token of the usual splitting holds letters and signs
            keep = keep and word in self  # rare words are kept once only
            found = self[word] + sign
        else:
            found = self.tokens.made(self.lead + piece) if self.lead or piece else b""
        if keep:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[piece] = found
        return found


class ByteTokens:
    """Ids of whole texts by a byte-level tokenizer file, and where sentences end, remembered by piece.

    A text is cut before each space that follows no white space, as no token reaches across such a place. Latin pieces are split here
    and merged part by part; any other piece, and a text with special tokens or rare separators, goes to the tokenizer whole."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        before = made.get("pre_tokenizer") or {}
        if made.get("normalizer") or made["model"]["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError(f"{path}: no byte-level model with the usual splitting and without normalisation")
        self.whole_only = [*"\x1c\x1d\x1e\x1f", *(t.content for t in self.tokenizer.get_added_tokens_decoder().values())]
        self.parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.latin = re.compile("[ \n!-~¡-¬®-ɏ]*").fullmatch
        self.runs = re.compile(r"\s*\S+|\s+").findall
        end = "[.!?…][\"'»”’)\\]]*"
        self.ends, self.ended = re.compile(rf"{end}(?=\s|\Z)").finditer, re.compile(rf"{end}\Z").search
        spaces = [c for c in map(chr, range(0x3001)) if c.isspace()]
        self.spaced = {True: [f"{c} " for c in spaces if c.isascii()], False: [f"{c} " for c in spaces]}
        # the printable stand-ins of byte-level models: visible Latin-1 as it is, the rest from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        byte_of = {**{chr(b): b for b in shown}, **{chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}}
        vocabulary = made["model"]["vocab"]
        merged = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in made["model"]["merges"]]
        if any(x >= y for x, y in pairwise(merged)):
            raise ValueError(f"{path}: merges are not in the order of their ids")
        # where ids follow the merges' order they are ranks, which this library merges by without a pattern of its own
        ranks = {bytes(byte_of[c] for c in token): k for token, k in vocabulary.items() if all(c in byte_of for c in token)}
        self.merged = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.signs = {c: bytes(self.made(c)) for c in ".,;:!?"}
        self.plain, self.after_space = Pieces(self, ""), Pieces(self, " ")

    def model(self, part: str) -> bytes:
        return array.array("I", self.merged(part.encode())).tobytes()

    def made(self, piece: str) -> bytes:
        if self.latin(piece):
            if piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha()):
                return self.model(piece)
            return b"".join(map(self.model, self.parts(piece)))
        return self.whole(piece)

    def whole(self, text: str) -> bytes:
        return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> tuple[bytes, list[int]]:
        """All ids as little-endian 32-bit integers, and how many there are when a sentence has ended."""
        if any(s in text for s in self.whole_only):
            return self.whole(text), []
        if any(s in text for s in self.spaced[text.isascii()]):
            return self.by_runs(text)
        plain, after_space = self.plain, self.after_space
        pieces = text.split(" ")
        made = list(map(after_space.__getitem__, pieces))
        made[0] = plain[pieces[0]]
        out, cuts, size, a, k, seen = [], [], 0, 0, 0, 0
        n, count, join = len(text), text.count, b"".join
        for m in self.ends(text):
            b = m.end()
            seen += count(" ", a, b)
            a = b
            if b == n or text[b] == " ":
                data = join(made[k : seen + 1])
                out.append(data)
                size += len(data) // 4
                k = seen + 1
                cuts.append(size)
            else:  # within a piece, before white space of another kind
                start = text.rfind(" ", 0, b) + 1
                head = (after_space if start else plain)[text[start:b]]
                cuts.append(size + (len(b"".join(made[k:seen])) + len(head)) // 4)
        out += made[k:]
        return b"".join(out), cuts

    def by_runs(self, text: str) -> tuple[bytes, list[int]]:
        """The same of a text with runs of white space."""
        out, cuts, size = [], [], 0
        for piece in self.runs(text):
            data = self.plain[piece]
            out.append(data)
            size += len(data) // 4
            if self.ended(piece):
                cuts.append(size)
        return b"".join(out), cuts


_tokens: dict[str, ByteTokens] = {}


def byte_tokens(path: str) -> ByteTokens:
    if path not in _tokens:
        _tokens[path] = ByteTokens(path)
    return _tokens[path]


# windows -------------------------------------------------------------------------------------


def places(n: int, cuts: list[int], stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """(places, costs) at which a document of ``n`` ids may be cut, its end last: where sentences end, every ``stride`` ids where these are farther apart, and the end."""
    at, cost, before = [], [], 0
    for c in (*cuts, n):
        if before < c <= n:
            if c - before > stride:
                between = range(before + stride, c, stride)
                at += between
                cost += [INSIDE_PENALTY] * len(between)
            at.append(c)
            cost.append(SENTENCE_PENALTY)
            before = c
    cost[-1] = 0
    return np.array(at), np.array(cost)


def windows(at: np.ndarray, cost: np.ndarray, capacity: int = CAPACITY) -> list[int]:
    """The places among the ascending ``at`` (no further apart than ``capacity``, the stream starts at 0) where windows end, the last included, for the least
    sum of paddings, of ``cost`` of each place but the last, and of windows."""
    n = len(at)
    place = np.concatenate([[0], at]).astype(np.int64)
    number = np.full(int(place[-1]) + 1, -1, np.int32)
    number[place] = np.arange(n + 1)
    froms, tos, size = [], [], 1
    while size <= capacity:
        k = np.searchsorted(place, size)
        source = number[place[k:] - size]
        hit = np.flatnonzero(source >= 0)
        froms.append(source[hit])
        tos.append(hit + k)
        size *= 2
    to = np.concatenate(tos)
    order = np.argsort(to, kind="stable")
    # by place's number: the places exactly a power of two back, one after the other
    to, source, at_hit = [*to[order].tolist(), -1], np.concatenate(froms)[order].tolist(), 0
    where, own = place.tolist(), [0, *cost.tolist()]
    own[n] = 0
    best, back = [0] * (n + 1), [0] * (n + 1)
    values: deque[int] = deque()  # best + place, ascending
    numbers: deque[int] = deque()
    last, more = 0, WINDOW_COST
    for j in range(1, n + 1):
        while values and values[-1] >= last:
            values.pop()
            numbers.pop()
        values.append(last)
        numbers.append(j - 1)
        p = where[j]
        low = p - capacity
        while where[numbers[0]] < low:
            values.popleft()
            numbers.popleft()
        least, via = values[0] + capacity - p, numbers[0]
        while to[at_hit] == j:
            i = source[at_hit]
            at_hit += 1
            if best[i] < least or best[i] == least and i < via:
                least, via = best[i], i
        back[j] = via
        best[j] = least = least + own[j] + more
        last = least + p
    out, j = [], n
    while j:
        out.append(where[j])
        j = back[j]
    return out[::-1]


# Spark ---------------------------------------------------------------------------------------

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Stream:
    """The ids of a partition's documents that no window has taken yet."""

    def __init__(self, first_sequence: int, capacity: int, keep_ids: bool):
        self.sequence, self.capacity, self.keep_ids = first_sequence, capacity, keep_ids
        self.held: list[tuple] = []  # (doc_id, ids, first id not taken, places, costs)
        self.size = 0

    def add(self, doc_id: int | None, data: bytes, cuts: list[int]) -> None:
        n = len(data) // 4
        self.held.append((doc_id, data, 0, *places(n, cuts, min(STRIDE, self.capacity))))
        self.size += n

    def cut(self, last: bool) -> list[tuple]:
        """Pieces of the windows that are settled; all, if nothing follows."""
        if not self.held:
            return []
        at, cost, base = [], [], 0
        for _, data, taken, own, penalty in self.held:
            at.append(own - taken + base)
            cost.append(penalty)
            base += len(data) // 4 - taken
        ends = windows(np.concatenate(at), np.concatenate(cost), self.capacity)
        if not last:
            ends = ends[:-1]
        out, k, begin = [], 0, 0
        doc_id, data, taken, own, penalty = self.held[0]
        for end in ends:
            offset = 0
            while offset < end - begin:
                n = min(len(data) // 4 - taken, end - begin - offset)
                ids = data[4 * taken : 4 * (taken + n)]
                out.append((doc_id, taken, n, zlib.crc32(ids), len(data) // 4, self.sequence, offset, np.frombuffer(ids, "<i4") if self.keep_ids else None))
                offset, taken = offset + n, taken + n
                if taken == len(data) // 4 and k + 1 < len(self.held):
                    k += 1
                    doc_id, data, taken, own, penalty = self.held[k]
            begin, self.sequence = end, self.sequence + 1
        left = own > taken
        self.held = [(doc_id, data, taken, own[left], penalty[left]), *self.held[k + 1 :]] if left.any() else self.held[k + 1 :]
        self.size = base - begin
        return out


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, closing: int = CLOSING, keep_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, start (its document's ids before it), length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if kept). A document is its ids and ``closing``."""
    kinds = [*(pa.int64() for _ in range(7)), pa.list_(pa.int32())]
    names = [*(f.split()[0] for f in PIECES.split(", ")), "ids"]

    def made(rows: list[tuple]):
        for k in range(0, len(rows), 4096):
            cols = list(zip(*rows[k : k + 4096], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[i], kinds[i]) for i in range(7 + keep_ids)], names[: 7 + keep_ids])

    def each(batches):
        tokens, end = byte_tokens(path), array.array("I", [closing]).tobytes()
        stream = Stream(TaskContext.get().partitionId() << 40, capacity, keep_ids)
        for whole in batches:
            for at in range(0, whole.num_rows, common.BATCH_ROWS):
                batch = whole.slice(at, common.BATCH_ROWS)
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), common.texts(batch), strict=True):
                    data, cuts = tokens.encode(text)
                    stream.add(doc_id, data + end, cuts)
                    if stream.size >= STREAM:
                        yield from made(stream.cut(False))
        yield from made(stream.cut(True))

    return common.doc_texts(docs).mapInArrow(each, PIECES + ", ids array<int>" * keep_ids)
