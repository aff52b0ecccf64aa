"""Periodic runs of words (text that repeats itself at once), by a suffix automaton whose link tree is accessed as a link-cut tree.

A run is a stretch of words with a smallest period that fits into it ``EXPONENT`` times or more and that no neighbouring word
continues. The automaton of the words read so far has a state for each class of repeated word strings; its suffix links form a tree in which the
path from the newest state to the root holds all suffixes. Link-cut access makes that path one piece, coloured with the newest end.
The pieces it was cut out of carry the end at which their strings were last seen: if that end lies no further back than the strings are long,
the suffix is a square, whose period is the distance of the two ends. A square is extended to both sides to its run. Pieces change
O(n log n) times for n words.

Only stretches of a text that can hold a run go through the automaton. In a run of period q, the strings of w words that start after its first q words have stood
q words or fewer before, one after the other; stretches with so many short distances are found by a sort of hashed w-word strings, for
each power of two that q may lie under. A hash that deceives gives a stretch too many, never one too few.

Texts are split at ASCII white space. Null texts and texts without a word count as empty: no run. Each row is handled by
itself, so repeated rows have equal results. Very long texts are one row each, and take memory in proportion to their words. Rows with a
null doc_id are kept. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: A run holds its period so often at least, and so many words.
EXPONENT, LEAST = 4, 6
#: Words of the strings whose distances tell where a run can be.
GRAM = 8

# squares -------------------------------------------------------------------------------------


def squares(codes: list[int], exponent: int = 2) -> Iterator[tuple[int, int]]:
    """(end, period) where a suffix of ``codes[:end + 1]`` is its first ``period`` words ``exponent`` times over. Each run of that exponent
    gives its period at each end from which on it is so long."""
    # the automaton: state 1 is the empty string, state 0 none
    to: list[dict[int, int]] = [{}, {}]
    length, link = [0, 0], [0, 0]
    # its links as splay trees, one a path; the root of each has the path's colour: where its strings ended last
    up, left, right, seen = [0, 0], [0, 0], [0, 0], [-1, -1]
    last = 1

    def splay(x: int) -> None:
        y = up[x]
        while y and (left[y] == x or right[y] == x):
            z = up[y]
            if z and (left[z] == y or right[z] == y):
                top = up[z]
                seen[x] = seen[z]
                if left[z] == y:
                    if left[y] == x:
                        b = right[y]
                        left[z] = b
                        if b:
                            up[b] = z
                        right[y], up[z] = z, y
                        b = right[x]
                        left[y] = b
                        if b:
                            up[b] = y
                        right[x], up[y] = y, x
                    else:
                        b, c = left[x], right[x]
                        right[y], left[z] = b, c
                        if b:
                            up[b] = y
                        if c:
                            up[c] = z
                        left[x], right[x], up[y], up[z] = y, z, x, x
                elif right[y] == x:
                    b = left[y]
                    right[z] = b
                    if b:
                        up[b] = z
                    left[y], up[z] = z, y
                    b = left[x]
                    right[y] = b
                    if b:
                        up[b] = y
                    left[x], up[y] = y, x
                else:
                    b, c = right[x], left[x]
                    left[y], right[z] = b, c
                    if b:
                        up[b] = y
                    if c:
                        up[c] = z
                    right[x], left[x], up[y], up[z] = y, z, x, x
                up[x] = top
                if top:
                    if left[top] == z:
                        left[top] = x
                    elif right[top] == z:
                        right[top] = x
                y = top
            else:
                seen[x] = seen[y]
                if left[y] == x:
                    b = right[x]
                    left[y] = b
                    if b:
                        up[b] = y
                    right[x] = y
                else:
                    b = left[x]
                    right[y] = b
                    if b:
                        up[b] = y
                    left[x] = y
                up[y], up[x] = x, z
                y = 0

    def state(n: int, parent: int, after: dict[int, int]) -> int:
        to.append(after)
        length.append(n)
        link.append(parent)
        up.append(0)
        left.append(0)
        right.append(0)
        seen.append(-1)
        return len(to) - 1

    for i, c in enumerate(codes):
        new, p = state(i + 1, 1, {}), last
        while p and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p:
            q = to[p][c]
            if length[q] > length[p] + 1:  # the shorter strings of q get a state of their own, above q on its path
                own = state(length[p] + 1, link[q], dict(to[q]))
                splay(q)
                b = left[q]
                left[own] = b
                if b:
                    up[b] = own
                left[q], up[own] = own, q
                link[q] = own
                while p and to[p].get(c) == q:
                    to[p][c] = own
                    p = link[p]
                q = own
            link[new] = q
        up[new] = link[new]
        last = new
        # access: the path from the root to ``new`` becomes one piece
        x, below = new, 0
        while x:
            splay(x)
            before = seen[x]
            if before >= 0 and length[x] >= (exponent - 1) * (i - before):
                yield i, i - before
            cut = right[x]
            if cut:
                seen[cut] = before
            right[x] = below
            below, x = x, up[x]
        seen[below] = i


# where runs can be ---------------------------------------------------------------------------


def distances(codes: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """For each ``width`` words of one text, how far back in it they stood before; a number that is too large if never."""
    n = len(codes) - width + 1
    far = np.iinfo(np.int64).max
    if n <= 0:
        return np.zeros(0, np.int64)
    h = codes.astype(np.uint64)[: n] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(1, width):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + codes[k : k + n].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    h ^= doc[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(h, kind="stable")
    again = h[order[1:]] == h[order[:-1]]
    out = np.full(n, far)
    out[order[1:][again]] = (order[1:] - order[:-1])[again]
    out[doc[:n] != doc[width - 1 :]] = far
    return out


def stretches(codes: np.ndarray, doc: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int]]:
    """Half-open stretches, apart from each other, that hold all runs of texts that are joined; ``doc`` is each word's text, ascending."""
    if not len(codes):
        return []
    first_of = np.searchsorted(doc, doc, "left")
    longest = int(np.bincount(doc).max())
    made: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    found: list[tuple[int, int]] = []
    top = 1
    while top // 2 + 1 <= longest // exponent:
        q = top // 2 + 1
        width = min(GRAM, 1 << ((exponent - 1) * q).bit_length() - 1)
        if width not in made:
            d = distances(codes, doc, width)
            at = np.flatnonzero(d < np.iinfo(np.int64).max)
            made[width] = at, d[at]
        at, d = made[width]
        near = at[d <= top]
        if len(near):
            edge = np.flatnonzero((np.diff(near) > 1) | (doc[near[1:]] != doc[near[:-1]])) + 1
            a, b = near[np.concatenate([[0], edge])], near[np.append(edge, len(near)) - 1]
            enough = b - a + 1 >= max(1, max(least, exponent * q) - q - width + 1)
            a, b = a[enough], b[enough] + width
            found += zip(np.maximum(a - top, first_of[a]).tolist(), b.tolist(), strict=True)
        top *= 2
    out: list[list[int]] = []
    for a, b in sorted(found):
        if out and a < out[-1][1] and doc[a] == doc[out[-1][1] - 1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def agreeing(x: np.ndarray, y: np.ndarray) -> int:
    """How many first values are equal."""
    n, at, step = min(len(x), len(y)), 0, 16
    while at < n:
        differ = x[at : min(n, at + step)] != y[at : min(n, at + step)]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + step, step * 4
    return n


def runs_in(codes: np.ndarray, at: int, end: int, first: int, past: int, exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, end, period) of the runs that a stretch of the text ``codes[first:past]`` holds."""
    found: dict[tuple[int, int], int] = {}
    until: dict[int, int] = {}
    for i, d in squares(codes[at:end].tolist(), exponent):
        i += at
        if i < until.get(d, 0):
            continue
        b = i + 1 + agreeing(codes[i + 1 : past], codes[i + 1 - d : past - d])
        a = i - d + 1 - agreeing(codes[first : i - d + 1][::-1], codes[first : i + 1][::-1])
        until[d] = b
        if b - a >= max(least, exponent * d):
            found[a, b] = min(d, found.get((a, b), d))
    return sorted((a, b, d) for (a, b), d in found.items())


def runs_of(texts: list[list[bytes]], exponent: int = EXPONENT, least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """Runs as (start, end, period) of each text, given its words, by start, then period."""
    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t), np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    start = np.concatenate([[0], np.cumsum(sizes)])
    doc = np.repeat(np.arange(len(texts)), sizes)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for a, b in stretches(codes, doc, exponent, least):
        k = int(doc[a])
        own = int(start[k])
        out[k] += [(x - own, y - own, d) for x, y, d in runs_in(codes, a, b, own, int(start[k + 1]), exponent, least)]
    return [sorted(set(r), key=lambda r: (r[0], r[2])) for r in out]


def kept(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds behind its first period."""
    if not found:
        return words
    keep = np.ones(len(words), bool)
    for a, b, d in found:
        keep[a + d : b] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


# Spark ---------------------------------------------------------------------------------------


def find(docs: DataFrame) -> DataFrame:
    """doc_id, runs (start, length and period of each, in words), text (its words without what runs repeat, joined by a space)."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [t.split() for t in common.raw(batch)]
        found = runs_of(words)
        runs = [[{"start": a, "length": b - a, "period": d} for a, b, d in r] for r in found]
        text = [b" ".join(kept(w, r)).decode("utf-8", "replace") for w, r in zip(words, found, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(runs, kind), pa.array(text, pa.string())], ["doc_id", "runs", "text"])

    return common.map_batches(common.doc_texts(docs), fn, "doc_id long, runs array<struct<start:long,length:long,period:long>>, text string")


def looped(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words as the query judges them: in each tenth text, by a hash of its number, what follows some place repeats what stands
    there. A text without a number stays as it is."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a + k % p] for k in range(n - a))]


DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_kept long"


def digest_documents(docs: DataFrame) -> DataFrame:
    """Per document, of its ``looped`` words: how many runs, the longest (of equally long ones the first, then the one of the shorter period), digests
    of all runs and of what is kept, and how many words there are and stay."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column("doc_id").to_pylist()
        words = [looped(t.split(), i) for t, i in zip(common.raw(batch), ids, strict=True)]
        out = []
        for i, w, found in zip(ids, words, runs_of(words), strict=True):
            best = min(((a - b, a, d) for a, b, d in found), default=None)
            shown = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
            lines, own = "".join(f"{a},{b - a},{d}\n" for a, b, d in found), kept(w, found)
            out.append((i, len(found), *shown, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(own)).hexdigest(), len(w), len(own)))
        cols = list(zip(*out, strict=True))
        names = [f.split()[0] for f in DIGEST.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n.endswith("sha256") else pa.int64()) for c, n in zip(cols, names, strict=True)], names)

    return common.map_batches(common.doc_texts(docs), fn, DIGEST)
