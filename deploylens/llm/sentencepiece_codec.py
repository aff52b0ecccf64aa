"""SentencePiece BPE encoding and decoding that keeps the source offsets of every piece.

Normalisation walks the model's compiled character map by longest prefix and records, for each
normalised character, the bytes of the source it came from. Pieces are merged on the normalised
text and projected through that record to byte spans of the original. A text is cut where no piece
of the vocabulary can reach across (before a space mark, or between two characters that stand side
by side in no piece); the parts repeat, so each worker keeps a bounded memo of them.

Nulls count as empty texts; an empty text has the begin and end ids only. Repeated rows each get a
row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from . import common

SPACE = "▁"
#: Parts remembered by a worker before its memo starts anew.
MEMO_PARTS = 400_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
NONE = float("inf")


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            at += n
            yield key >> 3, data[at - n : at]
        else:
            n = {1: 8, 5: 4}[kind]
            at += n
            yield key >> 3, struct.unpack("<d" if n == 8 else "<f", data[at - n : at])[0]


class CharacterMap:
    """The compiled map: a double-array trie of source byte strings, then the replacements it points to."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if size else ()
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, start: int) -> tuple[str, int] | None:
        """Replacement and length of the longest source string that begins at ``start``."""
        if not self.units:
            return None
        step = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        at, best = step(self.units[0]), None
        for end in range(start, len(data)):
            at ^= data[end]
            if at >= len(self.units) or self.units[at] & 0x800000FF != data[end]:
                break
            unit = self.units[at]
            at ^= step(unit)
            if unit & 256:
                best = self.units[at] & 0x7FFFFFFF, end + 1 - start
        if best is None:
            return None
        stop = self.strings.index(b"\0", best[0])
        return self.strings[best[0] : stop].decode("utf-8", "replace"), best[1]


class Codec:
    """Encoder and decoder of one BPE model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.pieces: list[tuple[str, float, int]] = []
        self.dummy_prefix, self.trim, self.escape, self.byte_fallback = True, True, True, False
        self.bos, self.eos, self.unk, charsmap = 1, 2, 0, b""
        self.unk_surface = " ⁇ "
        for number, value in fields(data):
            if number == 1:
                own = dict(fields(value))
                self.pieces.append((own[1].decode(), own.get(2, 0.0), own.get(3, NORMAL)))
            elif number == 2:
                own = dict(fields(value))
                if own.get(3, 1) != 2:
                    raise ValueError("only BPE models are read")
                self.byte_fallback = bool(own.get(35, 0))
                self.unk, self.bos, self.eos = own.get(40, 0), own.get(41, 1), own.get(42, 2)
                self.unk_surface = own.get(44, b" \xe2\x81\x87 ").decode()
            elif number == 3:
                own = dict(fields(value))
                charsmap = own.get(2, b"")
                self.dummy_prefix, self.trim, self.escape = (bool(own.get(n, 1)) for n in (3, 4, 5))
        self.charmap = CharacterMap(charsmap)
        self.ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER, UNUSED)}
        self.ranks = {p: -s for p, s, kind in self.pieces if kind in (NORMAL, USER)}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.joined = {p[k : k + 2] for p in self.ranks for k in range(len(p) - 1)}
        # surfaces by id; a byte over 127 stands as a lone surrogate until its neighbours are known
        self.surface = []
        for piece, _, kind in self.pieces:
            b = int(piece[3:5], 16) if kind == BYTE else 0
            self.surface.append("" if kind == CONTROL else self.unk_surface if kind == UNKNOWN else chr(b if b < 128 else 0xDC00 + b) if kind == BYTE else piece.replace(SPACE, " "))
        #: Text between spaces and line ends; exact only while pieces hold spaces at their start and no line end.
        plain = not any(SPACE in p.lstrip(SPACE) or ("\n" in p and p != "\n") for p in self.ranks)
        self.parts = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+" if plain else r"(?s).+").findall
        kinds = np.array([kind for *_, kind in self.pieces])
        lead = np.array([kind != BYTE or not 0x80 <= int(p[3:5], 16) < 0xC0 for p, _, kind in self.pieces])
        #: By id: whether it is a byte, whether it begins a character, and how many normalised characters it brings.
        self.is_byte, self.leads = kinds == BYTE, lead
        self.chars = np.where(self.is_byte, lead, np.where(kinds == CONTROL, 0, np.where(kinds == UNKNOWN, 1, [len(p) for p, *_ in self.pieces]))).astype(np.int64)
        self.memo: dict[str, bytes] = {}
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)

    # normalisation ---------------------------------------------------------------------------

    def normalise(self, text: str) -> tuple[str, list[tuple[int, int]]]:
        """The normalised text and, for each of its characters, its span of source bytes."""
        data, out, spans, at = text.encode("utf-8"), [], [], 0
        units = []
        while at < len(data):
            hit = self.charmap.longest(data, at)
            if hit is None:
                lead = data[at]
                n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                hit = data[at : at + n].decode("utf-8"), n
            units.append((hit[0], at, at + hit[1]))
            at += hit[1]
        for k, (s, a, b) in enumerate(units):
            # the source of a replacement of several characters belongs to its first one
            for j, c in enumerate(s):
                if self.trim and c == " " and (not out or out[-1] == " "):
                    continue
                out.append(c)
                spans.append((a, b) if j == 0 else (b, b))
        while self.trim and out and out[-1] == " ":
            out.pop()
            spans.pop()
        if self.dummy_prefix and out:
            out.insert(0, " ")
            spans.insert(0, (spans[0][0], spans[0][0]))
        made = "".join(out)
        return (made.replace(" ", SPACE) if self.escape else made), spans

    def plain(self, text: str) -> str:
        """The same text by string operations alone, where the model has no map and keeps white space."""
        return ((SPACE if self.dummy_prefix and text else "") + text).replace(" ", SPACE)

    # merging ---------------------------------------------------------------------------------

    def merge(self, word: str) -> list[int]:
        """Ids of ``word``: the best scored pair is merged first, the leftmost of equals."""
        n, ranks = len(word), self.ranks
        if n < 48:
            symbols = list(word)
            found = [ranks.get(a + b, NONE) for a, b in zip(word, word[1:], strict=False)]
            while found and (best := min(found)) != NONE:
                k = found.index(best)
                symbols[k : k + 2] = [made := symbols[k] + symbols[k + 1]]
                del found[k]
                if k < len(found):
                    found[k] = ranks.get(made + symbols[k + 1], NONE)
                if k:
                    found[k - 1] = ranks.get(symbols[k - 1] + made, NONE)
        else:
            sym, before, after = list(word), list(range(-1, n - 1)), [*range(1, n), -1]
            heap: list[tuple[float, int, int, int]] = []

            def offer(a: int, b: int) -> None:
                if a >= 0 and b >= 0 and (rank := ranks.get(sym[a] + sym[b])) is not None:
                    heapq.heappush(heap, (rank, a, b, len(sym[a]) + len(sym[b])))

            for k in range(n - 1):
                offer(k, k + 1)
            while heap:
                _, a, b, size = heapq.heappop(heap)
                if not sym[a] or not sym[b] or after[a] != b or len(sym[a]) + len(sym[b]) != size:
                    continue
                sym[a], sym[b] = sym[a] + sym[b], ""
                after[a] = after[b]
                if after[b] >= 0:
                    before[after[b]] = a
                offer(before[a], a)
                offer(a, after[a])
            symbols = [s for s in sym if s]
        out: list[int] = []
        for s in symbols:
            i = self.ids.get(s)
            if i is not None:
                out.append(i)
            elif self.byte_fallback:
                out += [self.bytes[b] for b in s.encode("utf-8")]
            else:
                out.append(self.unk)
        return out

    def pieces_of(self, part: str) -> list[int]:
        """Ids of a part, cut further where no piece can reach across."""
        joined, out, start = self.joined, [], 0
        for k in range(1, len(part) + 1):
            if k == len(part) or part[k - 1 : k + 1] not in joined:
                out += self.merge(part[start:k])
                start = k
        return out

    def learn(self, parts: set[str]) -> dict[str, bytes]:
        """Ids of parts not met before, as 32-bit integers. Those that are a space mark and a short word
        are merged by the library's BPE in one call, the others by ``merge``."""
        words = [p for p in parts if 1 < len(p) <= 64 and p[0] == SPACE and p[1] != SPACE] if self.simple and self.dummy_prefix else []
        made = dict(zip(words, (struct.pack(f"<{len(x)}I", *x) for x in self.library.encode([w[1:] for w in words], num_threads=1)), strict=True))
        for p in parts:
            if p not in made:
                made[p] = struct.pack(f"<{len(x := self.pieces_of(p))}I", *x)
        return made

    def known(self, texts: list[list[str]]) -> dict[str, bytes]:
        """Ids of every part of these texts; short ones stay in the memo."""
        fresh = {p for p in set().union(*texts) if p not in self.memo}
        made = self.learn(fresh)
        if len(self.memo) + len(made) > MEMO_PARTS:
            self.memo = {p: self.memo[p] for parts in texts for p in parts if p in self.memo}
        self.memo.update(made)
        return self.memo if all(len(p) <= 64 for p in made) else self.bounded(made)

    def bounded(self, made: dict[str, bytes]) -> dict[str, bytes]:
        """The memo as it is now; very long parts stay out of later ones."""
        now = self.memo
        self.memo = {p: x for p, x in now.items() if len(p) <= 64}
        return now

    @property
    def simple(self) -> bool:
        """Whether normalising only marks spaces, so that source bytes follow from the pieces alone."""
        return not self.charmap.units and not self.trim and self.escape and self.byte_fallback

    def aligned(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its characters, where its source ends. Without a map hit a character stands for itself, so
        the record is the running sum of the characters' bytes; with a map it is what ``normalise`` has walked over."""
        if not self.simple:
            made, spans = self.normalise(text)
            return made, np.array([e for _, e in spans], np.int64)
        code = np.frombuffer(text.encode("utf-32-le"), "<u4")
        ends = np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000), dtype=np.int64)
        return self.plain(text), np.concatenate([[0], ends]) if self.dummy_prefix and text else ends

    def encode_batch(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text: ids with begin and end, and for each id the first and past-the-last byte of its source, by the recorded alignment."""
        normal = [self.aligned(t) for t in texts]
        parts = [self.parts(made) for made, _ in normal]
        memo, out = self.known(parts), []
        for own, (_, record) in zip(parts, normal, strict=True):
            ids = np.frombuffer(b"".join([memo[p] for p in own]), "<u4")
            ends = self.project(ids, record)
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            n = ends[-1] if len(ends) else 0
            out.append((np.concatenate([[self.bos], ids, [self.eos]]).astype("<u4"), np.concatenate([[0], starts, [n]]).astype(np.int64), np.concatenate([[0], ends, [n]]).astype(np.int64)))
        return out

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.encode_batch([text])[0]

    def project(self, ids: np.ndarray, record: np.ndarray) -> np.ndarray:
        """Where the source of each piece ends, by the alignment of the normalised characters. Of the
        byte pieces of one character, each takes a byte while the source has one."""
        at = np.cumsum(self.chars[ids]) - 1
        if not len(at):
            return at
        own, k = self.is_byte[ids], np.arange(len(ids))
        nth = k - np.maximum.accumulate(np.where(self.leads[ids], k, 0)) + 1
        first = np.where(at > 0, record[at - 1], 0)
        return np.where(own, np.minimum(first + nth, record[at]), record[at])

    def decode(self, ids: np.ndarray) -> str:
        made = "".join(map(self.surface.__getitem__, ids.tolist()))
        if (self.dummy_prefix or self.trim) and made.startswith(" "):
            made = made[1:]
        if made.isascii():
            return made
        data = made.encode("utf-8", "surrogateescape")
        try:
            return data.decode("utf-8")
        except UnicodeDecodeError:  # each byte of no valid sequence becomes U+FFFD
            return re.sub("[\udc80-\udcff]", "\ufffd", data.decode("utf-8", "surrogateescape"))


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec for a model file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, ids, the source byte span of every id, and the decoded text."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        c, ids, starts, ends, back = codec(path), [], [], [], []
        for i, a, b in c.encode_batch(common.texts(batch)):
            ids.append(i.astype(np.int32))
            starts.append(a)
            ends.append(b)
            back.append(c.decode(i))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(back, pa.string())], ["doc_id", "ids", "starts", "ends", "decoded"])

    return common.map_batches(common.doc_texts(docs), fn, "doc_id long, ids array<int>, starts array<long>, ends array<long>, decoded string")


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """The digests of ``encode_documents`` without shipping ids back: doc_id, n_tokens, ids_sha256,
    decoded_sha256, n_source_bytes, where the last span ends, and spans_sha256, of the ends of all spans as 64-bit integers."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        c, n, ids_sha, text_sha, covered, spans_sha = codec(path), [], [], [], [], []
        for ids, _, ends in c.encode_batch(common.texts(batch)):
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
            text_sha.append(hashlib.sha256(c.decode(ids).encode("utf-8")).hexdigest())
            covered.append(int(ends[-1]))
            spans_sha.append(hashlib.sha256(ends.astype("<i8").tobytes()).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha), pa.array(covered, pa.int64()), pa.array(spans_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_source_bytes", "spans_sha256"])

    return common.map_batches(common.doc_texts(docs), fn, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_source_bytes long, spans_sha256 string")
