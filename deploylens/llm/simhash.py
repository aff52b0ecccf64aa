"""SimHash fingerprints and their links by meet-in-the-middle ball hashing.

Two fingerprints at most 2r bits apart have a fingerprint in common that lies within r bits of both. So every
distinct fingerprint emits all its variants within r bits, variants are shuffled, and fingerprints that meet
on one are linked; any two of them are within 2r bits by the triangle inequality, which the verification
repeats. A variant is dealt by its first bits, and only r of those can differ from the fingerprint's own: a
fingerprint is sent once to each bucket that holds any of its variants, and the bucket's task writes
out the variants that fall there. That moves a few dozen rows a fingerprint instead of thousands, and
loses none. A bucket's variants are sorted in blocks of bounded size.

Links are stars (smallest fingerprint of a variant to the others), thinned to a forest in each task; connected
components follow by hooking and pointer jumping over checkpoints. All of this is on distinct
fingerprints: copies meet before it, by aggregation.

Texts without a word have fingerprint zero, which links like any other. Rows with a null doc_id
keep their fingerprint and take the smallest doc_id of their component, null if there is none. Repeated rows
each get a row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 64
SHINGLE_WORDS = 4
MAX_DISTANCE = 4
#: Variants that a task sorts at once, about.
SORTED_VARIANTS = 2_000_000
SEED = 42


def fingerprint(text: bytes, words_each: int = SHINGLE_WORDS) -> int:
    """Bit b is 1 if more than half of the shingles' hashes have it."""
    words = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= words_each:
        return digest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - words_each + 1].tolist()
    hashes = np.fromiter([digest(line[a:b], SEED) for a, b in zip(starts, ends[words_each - 1 :].tolist(), strict=True)], np.uint64, len(starts))
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):  # a long text's bits in blocks
        counts += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(2 * counts > len(hashes)).tolist()))


def fingerprints(docs: DataFrame, words_each: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit integer."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = np.array([fingerprint(t, words_each) for t in common.raw(batch)], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made)], ["doc_id", "fp"])

    return common.map_batches(common.doc_texts(docs), fn, "doc_id long, fp long")


def flips(first: int, last: int, most: int) -> dict[int, np.ndarray]:
    """By number: masks with that many of the bits first..last-1 set, for up to ``most``."""
    return {k: np.array([sum(1 << b for b in c) for c in combinations(range(first, last), k)], np.uint64) for k in range(most + 1)}


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the edges (a, b) connect, one fewer than the nodes of each part: smallest node to each other."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    top = np.arange(len(nodes))
    while True:
        new = top.copy()
        np.minimum.at(new, top[x], top[y])
        np.minimum.at(new, top[y], top[x])
        while (new[new] != new).any():
            new = new[new]
        new = new[top]
        if (new == top).all():
            break
        top = new
    kept = top != np.arange(len(nodes))
    return nodes[top[kept]], nodes[kept]


def links(distinct: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of ``distinct.fp`` within ``max_distance`` bits. Variants
    are dealt by as many first bits as bring a bucket to about half of what is sorted at once."""
    radius = (max_distance + 1) // 2
    variants = distinct.count() * sum(math.comb(BITS, k) for k in range(radius + 1))
    prefix_bits = min(16, max(8, math.ceil(math.log2(1 + 2 * variants / SORTED_VARIANTS))))
    low = BITS - prefix_bits
    dealt = [(int(m), k) for k, masks in flips(0, prefix_bits, radius).items() for m in masks]
    inner = flips(0, low, radius)

    sent = F.explode(F.array(*(F.struct(F.lit(m).alias("mask"), F.lit(radius - k).alias("left")) for m, k in dealt)))
    own = F.shiftrightunsigned("fp", low)
    placed = distinct.select("fp", own.alias("own"), sent.alias("s")).select(F.col("own").bitwiseXOR(F.col("s.mask")).cast("int").alias("bucket"), "fp", F.col("s.left").alias("left"))
    spark = distinct.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = placed.repartition(parts, "bucket").sortWithinPartitions("bucket")

    def joined(fp: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges of one bucket: its variants' low bits are sorted, a range of their first bits at a time."""
        total = sum(len(inner[k]) * int((left >= k).sum()) for k in range(radius + 1))
        shares = 1
        while total / shares > 2 * SORTED_VARIANTS and shares < 1 << 20:
            shares *= 2
        mask, found_a, found_b = np.uint64((1 << low) - 1), [], []
        for share in range(shares):
            made, who = [], []
            for k in range(radius + 1):
                at = np.flatnonzero(left >= k)
                for block in range(0, len(at), max(1, SORTED_VARIANTS // len(inner[k]))):
                    rows = at[block : block + max(1, SORTED_VARIANTS // len(inner[k]))]
                    v = ((fp[rows] & mask)[:, None] ^ inner[k][None, :]).ravel()
                    w = np.repeat(rows, len(inner[k]))
                    if shares > 1:
                        hit = (v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44) & np.uint64(shares - 1) == share
                        v, w = v[hit], w[hit]
                    made.append(v)
                    who.append(w)
            v, w = np.concatenate(made), np.concatenate(who)
            order = np.argsort(v, kind="stable")
            v, w = v[order], w[order]
            same = np.flatnonzero(v[1:] == v[:-1])
            if len(same):  # neighbours on one variant chain all its fingerprints
                a, b = fp[w[same]], fp[w[same + 1]]
                a, b = np.minimum(a, b), np.maximum(a, b)
                pair = np.unique(np.stack([a, b], 1), axis=0)
                pair = pair[np.bitwise_count(pair[:, 0] ^ pair[:, 1]) <= max_distance]
                found_a.append(pair[:, 0])
                found_b.append(pair[:, 1])
        if not found_a:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        return forest(np.concatenate(found_a), np.concatenate(found_b))

    def each(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        bucket, out = None, []

        def flush():
            if held:
                fp, left = (np.concatenate(x) for x in zip(*held, strict=True))
                a, b = joined(fp, left)
                out.append((a.view(np.int64), b.view(np.int64)))
                held.clear()

        for batch in batches:
            keys, fp, left = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "fp", "left"))
            cuts = np.flatnonzero(np.diff(keys)) + 1
            for x, y in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if keys[x] != bucket:
                    flush()
                    bucket = keys[x]
                held.append((fp[x:y].astype(np.int64).view(np.uint64), left[x:y]))
            while out:
                a, b = out.pop()
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
        flush()
        while out:
            a, b = out.pop()
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return placed.mapInArrow(each, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(fp, root) for each node of ``edges``, root the smallest node of its component. A round hooks each root to
    the smallest root next to any of its nodes and jumps to that one's root. Each step is written out, so that
    both sides of every join are dealt anew and a node with very many edges can be split between tasks; what is spent is removed."""
    scratch = common.Scratch(edges.sparkSession)
    edges = scratch.written(edges, "links")
    if edges.isEmpty():
        return edges.select(F.col("b").alias("fp"), F.col("a").alias("root"))
    both = edges.union(edges.select(F.col("b"), F.col("a")))
    label = scratch.written(both.groupBy(F.col("a").alias("fp")).agg(F.least(F.col("fp"), F.min("b")).alias("root")).withColumn("was", F.col("root")), "labels")
    while True:
        near = both.join(label, both.b == label.fp).groupBy("a").agg(F.min("root").alias("near"))
        seen = scratch.written(label.join(near, label.fp == near.a).select("fp", "root", F.least("root", "near").alias("best")), "seen")
        hooked = scratch.written(seen.groupBy("root").agg(F.min("best").alias("up")), "hooked")
        moved = scratch.written(seen.join(hooked, "root").select("fp", "root", F.least("best", "up").alias("target")), "moved")
        onward = moved.select(F.col("fp").alias("node"), F.col("target").alias("next"))
        new = scratch.written(moved.join(onward, moved.target == onward.node).select("fp", F.least("target", "next").alias("root"), F.col("root").alias("was")), "labels")
        scratch.spent(label, seen, hooked, moved)
        label = new
        if new.filter("root <> was").isEmpty():
            scratch.spent(edges)
            return new.select("fp", "root")


def near_duplicates(docs: DataFrame, words_each: int = SHINGLE_WORDS, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id reachable)."""
    prints = common.checkpointed(fingerprints(docs, words_each))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(links(distinct.select("fp"), max_distance))
    member = found.join(distinct, "fp")
    least = member.groupBy("root").agg(F.min("first").alias("least"))
    linked = found.join(least, "root").select("fp", "least")
    resolved = common.written(distinct.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "resolved")
    return prints.join(resolved, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
