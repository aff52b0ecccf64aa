"""Exact repeats of so many bytes and more, by suffix arrays built from Lyndon groups; 400 bytes unless asked otherwise.

Which texts can share a 400-byte string is found first. Every 400-byte window takes the 32-byte gram with the
smallest hash as its anchor; equal windows have equal anchors at equal places. Windows next to each
other with one anchor form a region. Regions meet by anchor: copies of a region are one row with a count, and a
region whose anchor no other region has is settled by its count. The texts of the others are fetched, cut to
what agrees with another region around the anchor, and sorted: two 400-byte strings are equal if their
suffixes stand together in the suffix array and agree on 400 bytes.

Several widths are answered by one pass. A window of any width goes by the anchor of its first bytes, as many as the smallest width
has; equal windows have equal first bytes, so they meet as well. A region then reaches on as far as the largest width asks, and
one suffix array tells the equal strings of every width.

Equal windows have their anchors at equal places, so two regions can be equal only around it, up to where they first differ. What lies
between two neighbouring such places of an anchor's regions is one symbol of the suffix array.

The suffix array is built in two linear phases. The first groups the suffixes by their Lyndon prefix: groups are
taken in descending order, and the previous smaller suffix of each member moves to a new group right after its old one. The
second emits the order: each suffix, in turn, places the not yet placed suffix before it and that one's previous smaller
ones at the front of their groups. Nothing is renamed or sorted recursively.

The regions of an anchor with very many different ones are cut first, in a sort over all tasks. What is still too much is dealt over
blocks of bounded size; each block is sorted by itself, and its windows meet those of other blocks as fingerprints.

Matches never cross texts. Null texts count as empty. Repeated rows count as places of their own, so a row of 400
bytes or more that appears twice is removed whole. Rows with a null doc_id take part. Other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WIDTH = 400
#: Width for passages of over 50 words, which have about five bytes a word at least.
PASSAGE_WIDTH = 240
GRAM = 32
#: Windows of a text whose anchors are sought at once.
CHUNK = 1 << 19
#: Different regions of one anchor that are sorted together at most, about.
BLOCK_REGIONS = 192

# suffix array --------------------------------------------------------------------------------


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of ``text`` in order. Values are positive; a suffix that ends sorts first."""
    n = len(text) + 1
    s = [*text, 0]
    # groups by first value; group[i] is the first place of the group of suffix i
    size_of = [0] * (max(s) + 2)
    for v in s:
        size_of[v + 1] += 1
    first = list(size_of)
    for v in range(1, len(first)):
        first[v] += first[v - 1]
    sa, place, group, size = [0] * n, [0] * n, [0] * n, [0] * n
    at = list(first)
    for i, v in enumerate(s):
        sa[at[v]] = i
        place[i] = at[v]
        at[v] += 1
        group[i] = first[v]
    for v in range(len(first) - 1):
        if size_of[v + 1]:
            size[first[v]] = size_of[v + 1]
    before = [-1] * n
    end = n
    while end > 0:
        start = group[sa[end - 1]]
        members = sa[start:end]
        if len(members) > 1:
            members.sort()
        end = start
        seen: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = before[p]
            before[i] = p
            if p >= 0:
                seen[p] = seen.get(p, 0) + 1
        if not seen:
            continue
        most = max(seen.values())
        if most == 1:
            rounds = [list(seen)]
        else:  # those with more members after them are larger
            by: dict[int, list[int]] = defaultdict(list)
            for p, k in seen.items():
                by[k].append(p)
            rounds = [by[k] for k in sorted(by, reverse=True)]
        for moved in rounds:
            for p in moved:
                g = group[p]
                size[g] -= 1
                to, old = g + size[g], place[p]
                other = sa[to]
                sa[to], sa[old] = p, other
                place[p], place[other] = to, old
            fresh = [group[p] + size[group[p]] for p in moved]  # before any size grows again
            for p, g in zip(moved, fresh, strict=True):
                group[p] = g
                size[g] += 1
    # second phase
    front = list(range(n))
    out, placed = [0] * n, bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    front[group[n - 1]] += 1
    for k in range(n):
        p = out[k] - 1
        while p >= 0 and not placed[p]:
            g = group[p]
            out[front[g]] = p
            front[g] += 1
            placed[p] = 1
            p = before[p]
    return out[1:]


def equal_windows(texts: list[bytes], own: list[int], widths: tuple[int, ...]) -> dict[int, list[list[tuple[int, int]]]]:
    """For each width the classes of equal strings of ``texts``, as (text, start), classes of one included. Only the first ``own`` starts
    of a text count. The texts are joined with a separator that sorts first; a string that would cross it is none."""
    values: list[int] = []
    owner, start, joined = [], [], b"\0".join(texts)
    for k, t in enumerate(texts):
        values += [b + 2 for b in t]
        values.append(1)
        owner += [k] * (len(t) + 1)
        start += range(len(t) + 1)
    ends = [len(t) for t in texts]
    classes: dict[int, list[list[tuple[int, int]]]] = {w: [] for w in widths}
    found = [(w, classes[w], [b""]) for w in widths]
    for i in suffix_array(values):
        k, s = owner[i], start[i]
        if s >= own[k]:
            continue
        for width, those, last in found:
            if s + width > ends[k]:
                break
            window = joined[i : i + width]
            if window == last[0]:
                those[-1].append((k, s))
            else:
                those.append([(k, s)])
                last[0] = window
    return classes


# anchors -------------------------------------------------------------------------------------


def gram_hashes(x: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A mixed polynomial hash of every ``gram`` bytes (a power of two), by doubling."""
    h, n, base = x.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while n < gram:
        h = h[:-n] * np.uint64(base) + h[n:]
        n, base = 2 * n, base * base % 2**64
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def regions(text: bytes, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, anchor place, first window, past-the-last window) of the regions of a text of ``width`` bytes or more.

    Of equal hashes (by their upper 43 bits) the leftmost is the anchor, so a window's own bytes decide."""
    x, w, total = np.frombuffer(text, np.uint8), width - gram + 1, len(text) - width + 1
    low = np.uint64(21)
    found = []
    for at in range(0, total, CHUNK):
        n = min(CHUNK, total - at)
        h = gram_hashes(x[at : at + n + width - 1], gram)
        key = h >> low << low | np.arange(len(h), dtype=np.uint64)
        padded = np.full(-(-len(h) // w) * w, np.uint64(2**64 - 1))
        padded[: len(h)] = key
        square = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(square, 1).ravel()
        behind = np.minimum.accumulate(square[:, ::-1], 1)[:, ::-1].ravel()
        where = (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & np.uint64((1 << 21) - 1)).astype(np.int64)
        cut = np.flatnonzero(np.diff(where)) + 1
        first = np.concatenate([[0], cut])
        found.append((h[where[first]].view(np.int64), where[first] + at, first + at, np.concatenate([cut, [n]]) + at))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


# one anchor's regions ------------------------------------------------------------------------


def agreement(parts: list[bytes]) -> tuple[list[int], set[int]]:
    """For each, how many first bytes it shares with the one it shares most with; and every number of first bytes that any two share."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    out, bounds = [0] * len(parts), set()
    for a, b in zip(order, order[1:], strict=False):
        n = min(len(parts[a]), len(parts[b]))
        x = int.from_bytes(parts[a][:n], "big") ^ int.from_bytes(parts[b][:n], "big")
        same = n - (x.bit_length() + 7) // 8
        out[a], out[b] = max(out[a], same), max(out[b], same)
        bounds.add(same)
    return out, bounds


def runs(starts: list[int]) -> list[tuple[int, int]]:
    """Half-open runs of consecutive integers of an ascending list."""
    out: list[list[int]] = []
    for s in starts:
        if out and out[-1][1] == s:
            out[-1][1] = s + 1
        else:
            out.append([s, s + 1])
    return [(a, b) for a, b in out]


def whole(length: int, own: int, widths: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """Runs (first, past the last, width) of all windows of so many bytes that begin at the first ``own``."""
    return [(0, min(own, length - w + 1), w) for w in widths if length >= w]


def repeated(group: list[tuple[bytes, int, int, int]], widths: tuple[int, ...]) -> list[list[tuple[int, int, int]]]:
    """For each region (bytes, anchor's place in it, how many places it stands at, its windows): runs of repeated windows, with their width."""
    right, ends = agreement([r[o:] for r, o, _, _ in group])
    left, starts = agreement([r[:o][::-1] for r, o, _, _ in group])
    edges = ends | {-x for x in starts}  # places are counted from the anchor
    cut: dict[tuple[bytes, bytes, int | None], list[int]] = defaultdict(list)  # what is left of a region, to either side; where its windows end, if they do before it does
    out: list[list[tuple[int, int, int]]] = [[] for _ in group]
    for k, (r, o, count, own) in enumerate(group):
        if count > 1:
            out[k] = whole(len(r), own, widths)
        fit = right[k] - widths[0] + 1
        if min(own - o, fit) > -left[k]:
            limit = own - o if own - o < fit else None
            edges |= set() if limit is None else {limit}
            cut[r[o - left[k] : o], r[o : o + right[k]], limit].append(k)
    texts, held = list(cut), list(cut.values())
    if len(texts) == 1:
        before, after, limit = texts[0]
        ends_at = [(w, min(len(after) - w + 1, len(after) if limit is None else limit)) for w in widths]
        marks = [[(-len(before), b, w) for w, b in ends_at if b > -len(before)] if len(held[0]) > 1 else []]
    else:
        marks = [[(a, b, w) for w in widths for a, b in found[w]] for found in equal_stretches(texts, sorted(edges), [len(h) for h in held], widths)] if texts else []
    for those, found in zip(held, marks, strict=True):
        for k in those:
            if group[k][2] == 1:
                out[k] = [(a + group[k][1], b + group[k][1], w) for a, b, w in found]
    return out


def equal_stretches(texts: list[tuple[bytes, bytes, int | None]], edges: list[int], counts: list[int], widths: tuple[int, ...]) -> list[dict[int, list[list[int]]]]:
    """For each text (bytes before its anchor, bytes after, where its windows end) and width: runs of windows that another text has at
    the same place too, or that stand at several places (``counts``). Two texts agree from one of ``edges`` to another, and no further."""
    number = {p: k for k, p in enumerate(edges)}
    symbols: dict[tuple[int, bytes], int] = {}
    coded, values, owner, at = [], [], [], []
    for t, (before, after, _) in enumerate(texts):
        both, shift, a, b = before + after, len(before), number[-len(before)], number[len(after)]
        codes = [symbols.setdefault((k, both[edges[k] + shift : edges[k + 1] + shift]), len(symbols) + 2) for k in range(a, b)]
        coded.append((a, b, codes))
        values += codes
        values.append(1)
        owner += [t] * (b - a + 1)
        at += range(a, b + 1)
    sorted_at: list[list[int]] = [[] for _ in edges]  # the texts in the order of their suffixes from an edge
    for i in suffix_array(values):
        t, k = owner[i], at[i]
        if k < coded[t][1] and (texts[t][2] is None or edges[k] < texts[t][2]):
            sorted_at[k].append(t)
    out: list[dict[int, list[list[int]]]] = [{w: [] for w in widths} for _ in texts]
    for w in widths:
        for k, those in enumerate(sorted_at):
            if not those:
                continue
            x, e = edges[k], bisect_left(edges, edges[k] + w)
            while x < edges[k + 1] and e < len(edges):  # windows from x up to the next are those that end before edge e, or at it
                after = min(edges[k + 1], edges[e] - w + 1)
                same: list[int] = []
                last = None
                for t in [*those, None]:
                    if t is not None and coded[t][1] < e:
                        continue
                    code = None if t is None else coded[t][2][k - coded[t][0] : e - coded[t][0]]
                    if code != last:
                        if len(same) > 1 or same and counts[same[0]] > 1:
                            for u in same:
                                found = out[u][w]
                                if found and found[-1][1] == x:
                                    found[-1][1] = after
                                else:
                                    found.append([x, after])
                        same, last = [], code
                    same.append(t)
                x, e = after, e + 1
    return out


# Spark ---------------------------------------------------------------------------------------

PLACE = "id long, digest long"


def keyed(docs: DataFrame) -> DataFrame:
    """id, digest and text: rows that agree in the first two are one text to everything below."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), text).withColumn("digest", F.xxhash64("text"))


def moved(shift: str) -> Column:
    """``runs`` moved on by a column."""
    return F.transform("runs", lambda r: F.struct((r["a"] + F.col(shift)).alias("a"), (r["b"] + F.col(shift)).alias("b"), r["w"].alias("w"))).alias("runs")


def occurrences(rows: DataFrame, widths: tuple[int, ...]) -> DataFrame:
    """Every region of every text: id, digest, anchor, region (hash of its bytes and windows), first, length, at (anchor's place in it), own (its windows)."""
    width, far = widths[0], widths[-1]

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[], [], [], [], [], [], [], []]
        for i, digest, text in zip(batch.column("id").to_pylist(), batch.column("digest").to_pylist(), common.raw(batch), strict=True):
            if len(text) < width:
                continue
            anchor, where, first, last = regions(text, width)
            view, end, own = memoryview(text), np.minimum(last + far - 1, len(text)), last - first
            cols[0].append(np.full(len(first), i))
            cols[1].append(np.full(len(first), digest))
            cols[2].append(anchor)
            cols[3].append(np.fromiter([xxhash.xxh3_64_intdigest(view[a:b], n) for a, b, n in zip(first.tolist(), end.tolist(), own.tolist(), strict=True)], np.uint64, len(first)).view(np.int64))
            cols[4].append(first)
            cols[5].append(end - first)
            cols[6].append(where - first)
            cols[7].append(own)
        if not cols[0]:
            return None
        flat = [np.concatenate(c) for c in cols]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(flat, kinds, strict=True)], ["id", "digest", "anchor", "region", "first", "length", "at", "own"])

    return common.map_batches(rows.select("id", "digest", "text"), fn, f"{PLACE}, anchor long, region long, first int, length int, at int, own int")


FETCHED = "anchor long, region long, count long, different long, own int, left binary, right binary"


def fetch(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """The bytes of the regions in ``wanted``, from the text that each names: what is left of the anchor, backwards, and the rest."""
    asked = wanted.groupBy("id", "digest").agg(F.collect_list(F.struct("anchor", "region", "count", "different", "own", "first", "length", "at")).alias("asked"))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, asked_for in zip(common.raw(batch), batch.column("asked").to_pylist(), strict=True):
            for a in asked_for:
                data = text[a["first"] : a["first"] + a["length"]]
                out.append((a["anchor"], a["region"], a["count"], a["different"], a["own"], data[: a["at"]][::-1], data[a["at"] :]))
        cols = list(zip(*out, strict=True))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], ["anchor", "region", "count", "different", "own", "left", "right"])

    return common.map_batches(rows.join(asked, ["id", "digest"]).select("text", "asked"), fn, FETCHED)


def agreements(crowded: DataFrame, side: str) -> DataFrame:
    """(anchor, region, side): how many bytes of that side a region shares with the one of its anchor it shares most with.

    The regions of an anchor are sorted over all tasks, and each compared with its two neighbours. The first and the
    last of a task, whose neighbour is elsewhere, count as agreeing wholly, which keeps more than need be and loses nothing."""
    n = int(crowded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = crowded.select("anchor", "region", side).repartitionByRange(n, "anchor", side, "region").sortWithinPartitions("anchor", side, "region")

    def shared(a: bytes, b: bytes) -> int:
        m = min(len(a), len(b))
        return m - ((int.from_bytes(a[:m], "big") ^ int.from_bytes(b[:m], "big")).bit_length() + 7) // 8

    def made(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32()), strict=True)], ["anchor", "region", side])

    def each(batches):
        last, most, out = None, 0, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "region", side)), strict=True):
                if last is None:
                    most = len(row[2])
                else:
                    same = shared(last[2], row[2]) if last[0] == row[0] else 0
                    out.append((last[0], last[1], max(most, same)))
                    most = same
                last = row
            if len(out) > 5000:
                yield made(out)
                out = []
        if last is not None:
            yield made([*out, (last[0], last[1], len(last[2]))])

    return dealt.mapInArrow(each, f"anchor long, region long, {side} int")


def crowds(crowded: DataFrame, scratch: common.Scratch, widths: tuple[int, ...]) -> DataFrame:
    """(anchor, region, runs) for anchors with very many different regions. Each region is cut to what it shares with any other;
    most then are the same, and the different ones are sorted in blocks. Windows that stand alone in their block meet those of the others as fingerprints."""
    cut = crowded.join(agreements(crowded, "left").withColumnRenamed("left", "l"), ["anchor", "region"]).join(agreements(crowded, "right").withColumnRenamed("right", "r"), ["anchor", "region"])
    shift = (F.length("left") - F.col("l")).cast("int")
    cut = cut.withColumn("shift", shift).withColumn("own", F.least(F.col("own") - F.col("shift"), F.col("l") + F.col("r") - widths[0] + 1).cast("int")).filter("own > 0")
    left, right = F.substring("left", F.lit(1), F.col("l")), F.substring("right", F.lit(1), F.col("r"))
    piece = F.xxhash64(left, F.lit("/"), right, "own").alias("piece")
    cut = scratch.written(cut.select("anchor", "region", "count", piece, "shift", "own", left.alias("left"), right.alias("right")), "crowds")
    texts = cut.groupBy("anchor", F.col("piece").alias("region")).agg(F.sum("count").alias("count"), F.first("own").alias("own"), F.first("left").alias("left"), F.first("right").alias("right"))
    per = cut.select("anchor", "piece").distinct().groupBy("anchor").agg(F.count("*").alias("different"))
    settled = scratch.written(sorted_groups(texts.join(per, "anchor"), widths), "crowds-settled")
    direct = settled.filter("runs IS NOT NULL").select("anchor", F.col("region").alias("piece"), "runs")
    again = settled.filter("print IS NOT NULL").groupBy("print").agg(F.sum("count").alias("total")).filter("total > 1").select("print")
    late = settled.filter("print IS NOT NULL AND region IS NOT NULL").join(again, "print")
    late = late.select("anchor", F.col("region").alias("piece"), F.array(F.struct(F.col("start").alias("a"), (F.col("start") + 1).alias("b"), F.col("width").alias("w"))).alias("runs"))
    every = scratch.written(direct.unionByName(late).groupBy("anchor", "piece").agg(F.flatten(F.collect_list("runs")).alias("runs")), "crowds-repeated")
    return cut.select("anchor", "region", "piece", "shift").join(every, ["anchor", "piece"]).select("anchor", "region", moved("shift"))


def sorted_groups(fetched: DataFrame, widths: tuple[int, ...]) -> DataFrame:
    """Per region with a repeated window: anchor, region, runs. Of anchors in several blocks also rows of
    (print, count) for each different window; those that stand alone in their block name the region, the start and the width."""
    blocks_of = F.ceil(F.col("different") / BLOCK_REGIONS).cast("int")
    block = F.pmod("region", blocks_of).cast("int").alias("block")
    n = int(fetched.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = fetched.select("*", blocks_of.alias("blocks"), block).repartition(n, "anchor", "block").sortWithinPartitions("anchor", "block", "region")
    names = ["anchor", "region", "runs", "print", "count", "start", "width"]
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("w", pa.int32())]))

    def settle(held: dict[int, tuple[bytes, int, int, int]], anchor: int, blocks: int) -> list[tuple]:
        keys, group = list(held), list(held.values())
        if blocks == 1:
            return [(anchor, k, r, None, None, None, None) for k, r in zip(keys, repeated(group, widths), strict=True) if r]
        out, marks = [], [[] for _ in keys]
        for width, classes in equal_windows([g[0] for g in group], [g[3] for g in group], widths).items():
            found: dict[int, list[int]] = defaultdict(list)
            for same in classes:
                k, s = same[0]
                total = sum(group[j][2] for j, _ in same)
                mark = xxhash.xxh3_128_digest(group[k][0][s : s + width])
                if total > 1:
                    out.append((None, None, None, mark, total, None, None))
                    for j, at in same:
                        found[j].append(at)
                else:
                    out.append((anchor, keys[k], None, mark, 1, s, width))
            for j, starts in found.items():
                marks[j] += [(a, b, width) for a, b in runs(sorted(starts))]
        return out + [(anchor, k, m, None, None, None, None) for k, m in zip(keys, marks, strict=True) if m]

    def each(batches):
        at, held, blocks, out = None, {}, 1, []

        def made():
            cols = list(zip(*out, strict=True))
            lists = [None if r is None else [{"a": a, "b": b, "w": w} for a, b, w in r] for r in cols[2]]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(lists, kind), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.int32()), pa.array(cols[6], pa.int32())], names)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "block", "region", "left", "right", "count", "own", "blocks")), strict=True):
                if row[:2] != at:
                    if held:
                        out += settle(held, at[0], blocks)
                    at, held, blocks = row[:2], {}, row[7]
                    if len(out) > 5000:
                        yield made()
                        out = []
                held[row[2]] = row[3][::-1] + row[4], len(row[3]), row[5], row[6]
        if held:
            out += settle(held, at[0], blocks)
        if out:
            yield made()

    return dealt.mapInArrow(each, "anchor long, region long, runs array<struct<a:int,b:int,w:int>>, print binary, count long, start int, width int")


def removed(docs: DataFrame, *widths: int) -> tuple[DataFrame, DataFrame]:
    """(rows, marks): the keyed rows, and per (id, digest) the runs of repeated windows of its text, of each width (400 bytes if none is named)."""
    widths = tuple(sorted(set(widths or (WIDTH,))))
    rows, scratch = keyed(docs), common.Scratch(docs.sparkSession)
    found = scratch.written(occurrences(rows, widths), "regions")
    sole = F.min(F.struct("id", "digest", "first", "length", "at", "own")).alias("one")
    distinct = found.groupBy("anchor", "region").agg(F.count("*").alias("count"), sole)
    distinct = scratch.written(distinct.select("anchor", "region", "count", "one.*"), "distinct")
    many = distinct.groupBy("anchor").agg(F.count("*").alias("different")).filter("different > 1")
    each = [F.struct(F.lit(0).alias("a"), F.least(F.col("own"), F.col("length") - w + 1).cast("int").alias("b"), F.lit(w).alias("w")) for w in widths]
    alone = distinct.filter("count > 1").select("anchor", "region", F.filter(F.array(*each), lambda r: r["b"] > 0).alias("runs"))
    few = F.col("different") <= BLOCK_REGIONS
    fetched = scratch.written(fetch(distinct.join(many, "anchor"), rows), "fetched")
    direct = sorted_groups(fetched.filter(few), widths).select("anchor", "region", "runs")
    every = alone.unionByName(direct).unionByName(crowds(fetched.filter(~few), scratch, widths))
    every = scratch.written(every.groupBy("anchor", "region").agg(F.flatten(F.collect_list("runs")).alias("runs")), "repeated")
    places = found.select("id", "digest", "anchor", "region", "first").distinct()  # rows that share number and text have their places once
    marks = places.join(every, ["anchor", "region"]).select("id", "digest", moved("first"))
    marks = common.written(marks.groupBy("id", "digest").agg(F.flatten(F.collect_list("runs")).alias("runs")), "repeats")
    scratch.spent()
    return rows, marks


def spans_of(batch: pa.RecordBatch, width: int, column: str = "runs") -> list[list[tuple[int, int]]]:
    """For each row the maximal runs of bytes that its repeated windows of ``width`` cover."""
    lists = batch.column(column)
    ends = lists.offsets.to_numpy()
    first, past, w = (lists.values.field(c).to_numpy(zero_copy_only=False)[ends[0] : ends[-1]] for c in ("a", "b", "w"))
    row = np.repeat(np.arange(len(lists)), np.diff(ends))[w == width] << 32
    a, b = row + first[w == width], row + past[w == width] + (width - 1)
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    head = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]])) if len(a) else np.zeros(0, np.int64)
    a, b = a[head], b[np.concatenate([head[1:] - 1, [len(b) - 1]])] if len(head) else a
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(lists))]
    low = (1 << 32) - 1
    for k, x, y in zip((a >> 32).tolist(), (a & low).tolist(), (b & low).tolist(), strict=True):
        out[k].append((x, y))
    return out


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """What is left of a text without its spans."""
    edges = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2)) if spans else text


def digest_documents(docs: DataFrame, width: int = WIDTH, passage: int = PASSAGE_WIDTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept, and of the passages of over 50 words that stand elsewhere too, which may be
    shorter than ``width``: n_passage_bytes, n_passages, passage_kept_sha256. Like the former, they are judged on the input."""
    rows, marks = removed(docs, width, passage)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, *both in zip(common.raw(batch), spans_of(batch, width), spans_of(batch, passage), strict=True):
            row = [len(text)]
            for spans in both:
                if spans == both[0] and len(row) > 1:
                    row += row[1:]
                    continue
                kept = cut(text, spans)
                row += [len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()]
            out.append(row)
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), *(pa.int64(), pa.int64(), pa.string()) * 2), strict=True))], ["id", *names])

    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes", "n_passages", "passage_kept_sha256"]
    kinds = ", ".join(f"{c} {'string' if c.endswith('sha256') else 'long'}" for c in names)
    done = common.map_batches(rows.join(marks, ["id", "digest"], "left").select("id", "text", "runs"), fn, f"id long, {kinds}")
    return done.select(F.nullif("id", F.lit(-(2**63))).alias("doc_id"), *names[:4], (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"), *names[4:])


def strip_repeats(docs: DataFrame, width: int = PASSAGE_WIDTH) -> DataFrame:
    """``docs`` without their repeated strings, cut at whole characters; other columns as they are, n_chars
    follows the text. No row is dropped. Every copy of a passage goes, the first too: what stands word for word in several documents is
    a licence, a menu or a leaked test passage, and near copies of whole documents have been dealt with before."""
    _, marks = removed(docs, width)
    key, digest, runs_of = (common.free_name(docs, f"_{n}") for n in ("id", "digest", "runs"))
    own = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))).withColumn(digest, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    joined = own.join(marks.select(F.col("id").alias(key), F.col("digest").alias(digest), F.col("runs").alias(runs_of)), [key, digest], "left")

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = {c: batch.column(c) for c in batch.schema.names if c != runs_of}
        text = []
        for was, t, spans in zip(batch.column("text").to_pylist(), common.raw(batch), spans_of(batch, width, runs_of), strict=True):
            text.append(cut(t, spans).decode("utf-8", "ignore") if spans else was)
        cols["text"] = pa.array(text, pa.string())
        return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    made = common.map_batches(joined.select(*docs.columns, runs_of), fn, docs.schema)
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return made
