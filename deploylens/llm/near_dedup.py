"""Near-duplicate documents: SimHash views, ball hashing, exact verification, one document of each group kept.

One 64-bit fingerprint within four bits finds copies with very few edits only: at a similarity of 0.8, fingerprints differ in a
sixth of their bits. So each distinct text (a node) has a print of 192 bits over its five-word shingles, which is six independent
32-bit SimHash views. Two nodes are candidates if a view of theirs differs in four bits or fewer, which meeting in the middle finds:
both have a variant within two bits in common. Two such views agree on one of five blocks of bits (more blocks, and more of them,
for more nodes), so a view is sent once for each block to the bucket of its block's value, and the bucket's task writes out the
variants of the other bits, sorts them, and keeps the candidates whose prints are near enough for a similarity of 0.8.

A bucket's candidates leave it as a forest, one row a node at most. The components of all forests are blocks: whatever has to be compared
stands in one. The shingle sets of a block meet in one task, or in several tiles if it is large, and nodes of exact Jaccard similarity
0.8 (of sets of 64-bit hashes) are linked; each text that is linked to others is compared with the block's members until it belongs
to the largest group, so a crowd of copies costs one comparison each. Of a large block, those that are copies of its
central text are only compared with those that are not. Groups are the components of the links. Equal texts (128-bit hash)
are one node throughout, so copies are never paired, and no step has rows for the pairs of a group.

Null texts count as empty, and texts without words are copies of each other only if equal. Very long texts are sketched in
pieces and compared whole. The document with the smallest doc_id of a group stays (null ids last, then the smaller text hash); of repeated
rows, one. Other columns stay as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, simhash

WORDS, SIMILARITY = 5, 0.8
#: 64-bit words of a print; each is two views.
PRINT_WORDS, VIEW_BITS, RADIUS = 3, 32, 2
#: Bits of a print that candidates may differ in: three deviations above what a similarity of 0.8 has, while random prints differ in 96.
PRINT_DISTANCE = 44
#: Nodes of a bucket that one task holds; a bucket with more is dealt over pairs of shares of it.
BUCKET_NODES = 40_000
#: Variants sorted at once.
SORTED_VARIANTS = 1_000_000
#: Pairs whose prints are compared at once.
PAIRS = 1 << 18
#: Nodes and shingles of a tile's side, about.
TILE_NODES, TILE_SHINGLES = 1024, 400_000
#: Bits of a tile's shingles that are compared at once.
TILE_BITS = 1 << 14
NO_ID = 2**63 - 1
_LANES = np.random.default_rng(11).integers(1, 2**63, PRINT_WORDS, dtype=np.uint64) | np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """Sorted hashes of the different five-word shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line, n = b" ".join(words), max(1, len(words) - WORDS + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter([digest(line[a:b], simhash.SEED) for a, b in zip(starts, ends[-n:].tolist(), strict=True)], np.uint64, n))


def print_of(hashes: np.ndarray) -> np.ndarray:
    """The print: bit b is 1 if more than half of the shingles' mixed hashes have it."""
    counts = np.zeros(64 * PRINT_WORDS, np.int64)
    for k in range(0, len(hashes), 4096):
        h = hashes[k : k + 4096, None] * _LANES[None, :]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        counts += np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)


# candidates ----------------------------------------------------------------------------------


def blocks_of_bits(nodes: int, limit: int = BUCKET_NODES) -> list[int]:
    """Masks of the bits of a view that candidates must agree on in one bucket. Views within 2 * RADIUS bits agree on
    ``agree`` of that many more blocks; there are as many as bring a bucket of evenly spread nodes below the limit."""
    agree = 1
    while agree < 4 and nodes / 2 ** (agree * VIEW_BITS / (agree + 2 * RADIUS)) > limit:
        agree += 1
    edges = np.linspace(0, VIEW_BITS, agree + 2 * RADIUS + 1).round().astype(int)
    own = [sum(1 << b for b in range(x, y)) for x, y in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(own, agree)]


def flips(bits: list[int], most: int) -> np.ndarray:
    """All masks with up to ``most`` of the bits."""
    return np.array([sum(1 << b for b in c) for k in range(most + 1) for c in combinations(bits, k)], np.uint64)


def gathered(prints: np.ndarray, view: int, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest (a, b) of the nodes of one bucket, by place: what shares a variant and has near prints is connected."""
    n = len(prints)
    fp = prints[:, view // 2] >> np.uint64(VIEW_BITS * (view % 2)) & np.uint64(2**VIEW_BITS - 1)
    free = [b for b in range(VIEW_BITS) if not mask >> b & 1]
    masks, label = flips(free, RADIUS), np.arange(n)
    near = lambda a, b: np.bitwise_count(prints[a] ^ prints[b]).sum(1) <= PRINT_DISTANCE

    def merge(a: np.ndarray, b: np.ndarray) -> None:
        """Connects the pairs whose prints are near."""
        own = label[a] != label[b]
        a, b = a[own], b[own]
        for at in range(0, len(a), PAIRS):
            x, y = a[at : at + PAIRS], b[at : at + PAIRS]
            hit = near(x, y)
            if hit.any():
                top, low = simhash.forest(label[x[hit]], label[y[hit]])
                move = np.arange(n)
                move[low] = top
                label[:] = move[label]

    shares = 1 << max(0, math.ceil(math.log2(n * len(masks) / SORTED_VARIANTS)))
    for share in range(shares):
        made = []
        for at in range(0, n, max(1, SORTED_VARIANTS // len(masks))):
            rows = np.arange(at, min(n, at + max(1, SORTED_VARIANTS // len(masks))), dtype=np.uint64)
            v = (fp[rows][:, None] ^ masks[None, :]).ravel()
            packed = v << np.uint64(32) | np.repeat(rows, len(masks))
            if shares > 1:
                packed = packed[(v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40) & np.uint64(shares - 1) == share]
            made.append(packed)
        packed = np.concatenate(made)
        made.clear()
        packed.sort()
        v, w = (packed >> np.uint64(32)).astype(np.uint32), (packed & np.uint64(2**32 - 1)).astype(np.int32)
        del packed
        same = v[1:] == v[:-1]
        i = np.flatnonzero(same)
        if not len(i):
            continue
        merge(w[i], w[i + 1])
        # what is left: variants of three and more nodes that are not all connected
        edge = np.flatnonzero(np.concatenate([[True], ~same]))
        size = np.diff(np.append(edge, len(v)))
        edge, size = edge[size > 2], size[size > 2]
        lag = 2
        while len(edge):
            if lag & lag - 1 == 0:
                at = np.stack([edge, edge + size], 1).ravel()
                own = np.append(label[w], 0)
                split = np.minimum.reduceat(own, at)[::2] != np.maximum.reduceat(own, at)[::2]
                edge, size = edge[split], size[split]
            if lag > 32:
                break
            edge, size = edge[size > lag], size[size > lag]
            pairs = size - lag
            i = np.repeat(edge - np.cumsum(pairs) + pairs, pairs) + np.arange(int(pairs.sum()))
            merge(w[i], w[i + lag])
            lag += 1
        for at, many in zip(edge.tolist(), size.tolist(), strict=True):  # those outside the largest part, each against all others
            own = w[at : at + many]
            names, counts = np.unique(label[own], return_counts=True)
            for x in own[label[own] != names[counts.argmax()]].tolist():
                rest = own[label[own] != label[x]]
                merge(np.full(len(rest), x), rest)
    low = np.flatnonzero(label != np.arange(n))
    return label[low], low


def candidates(nodes: DataFrame, limit: int = BUCKET_NODES) -> DataFrame:
    """Edges (a, b) that connect the nodes of (node, p0, p1, p2) which are candidates of each other."""
    spark, masks = nodes.sparkSession, blocks_of_bits(nodes.count(), limit)
    buckets = []
    for view in range(2 * PRINT_WORDS):
        fp = F.shiftrightunsigned(f"p{view // 2}", VIEW_BITS * (view % 2)).bitwiseAND(F.lit(2**VIEW_BITS - 1))
        for k, mask in enumerate(masks):
            buckets.append(fp.bitwiseAND(F.lit(mask)) + F.lit(view * len(masks) + k << VIEW_BITS))
    names = [f"p{k}" for k in range(PRINT_WORDS)]
    placed = nodes.select("node", *names, F.explode(F.array(*buckets)).alias("bucket"))
    crowded = common.written(placed.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > limit), "crowded")
    held = crowded.count()
    if held:  # a share of a bucket meets itself and each other share in a tile of its own
        few = crowded.select("bucket", F.ceil(F.col("n") / limit).cast("int").alias("shares"))
        placed = placed.join(F.broadcast(few) if held <= 100_000 else few, "bucket", "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
        own = F.pmod(F.xxhash64("node"), F.col("shares")).cast("int")
        placed = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        placed = placed.withColumn("tile", F.least("own", "other") * F.col("shares") + F.greatest("own", "other"))
    else:
        placed = placed.withColumn("tile", F.lit(0))
    dealt = placed.select("bucket", "tile", "node", *names).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket", "tile").sortWithinPartitions("bucket", "tile")

    def each(batches):
        for bucket, (tile, node, *words) in common.groups_of(batches, "bucket", ("tile", "node", *names)):
            edges = [0, *(np.flatnonzero(np.diff(tile)) + 1), len(tile)]
            for x, y in zip(edges, edges[1:], strict=False):
                if y - x > 1:
                    kind = int(bucket) >> VIEW_BITS
                    own = node[x:y]
                    a, b = gathered(np.stack([w[x:y] for w in words], 1).view(np.uint64), kind // len(masks), masks[kind % len(masks)])
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(own[a], own[b])), pa.array(np.maximum(own[a], own[b]))], ["a", "b"])

    return thinned(dealt.mapInArrow(each, "a long, b long"))


def thinned(edges: DataFrame) -> DataFrame:
    """Fewer edges that connect the same: a node keeps its smallest neighbour, to which the others are moved. Neighbours of many nodes
    then fall together, while each node had one from each of its buckets."""
    near = edges.groupBy("b").agg(F.collect_set("a").alias("s")).withColumn("a", F.array_min("s"))
    moved = F.array_append(F.array_except("s", F.array("a")), F.col("b"))
    return near.select("a", F.explode(moved).alias("b")).distinct()


# exact similarity ----------------------------------------------------------------------------


def linked(sets: list[np.ndarray], asked: np.ndarray) -> list[int]:
    """Label of each set: the components of the pairs of similarity 0.8 and more of which one is asked.

    Each set asked is compared with all that are not in its group yet, largest group last, as what is left out of that needs no comparison."""
    n = len(sets)
    label = np.arange(n)
    if n == 2:
        if asked.any():
            shared = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
            label[1] = 0 if shared >= SIMILARITY * (len(sets[0]) + len(sets[1]) - shared) else 1
        return label.tolist()
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), size)
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = count[code] > 1
    rank = np.cumsum(count > 1) - 1
    owner, code, bits = owner[several], rank[code[several]], int((count > 1).sum())
    slices = []
    for at in range(0, bits, TILE_BITS):
        own = (code >= at) & (code < at + TILE_BITS)
        grid = np.zeros((n, -(-min(TILE_BITS, bits - at) // 64) * 64), bool)
        grid[owner[own], code[own] - at] = True
        slices.append(np.packbits(grid, axis=1).view(np.uint64))
    for i in np.flatnonzero(asked).tolist():
        rest = np.flatnonzero(label != label[i])
        if not len(rest):
            break
        shared = sum((np.bitwise_count(s[rest] & s[i]).sum(1, dtype=np.int64) for s in slices), np.zeros(len(rest), np.int64))
        for j in np.unique(label[rest[shared >= SIMILARITY * (size[i] + size[rest] - shared)]]).tolist():
            label[label == max(j, label[i])] = min(j, label[i])
    return label.tolist()


def tiled(sets: DataFrame) -> DataFrame:
    """Edges (a, b), a star for each group that a tile finds, of (tile, root, node, asked, shingles)."""
    spark = sets.sparkSession
    dealt = sets.select(F.xxhash64("root", "tile").alias("key"), "root", "tile", "node", "asked", "shingles")
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key", "root", "tile")

    def each(batches):
        at, held = None, {}

        def settled():
            node, asked, sets = zip(*((k, a, s) for k, (a, s) in held.items()), strict=True)
            label = linked([np.frombuffer(s, np.uint64) for s in sets], np.array(asked))
            first: dict[int, int] = {}
            for x, own in zip(label, node, strict=True):
                first[x] = min(own, first.get(x, own))
            pairs = [(first[x], own) for x, own in zip(label, node, strict=True) if first[x] != own]
            if pairs:
                a, b = zip(*pairs, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for root, tile, *row in zip(*(batch.column(c).to_pylist() for c in ("root", "tile", "node", "asked", "shingles")), strict=True):
                if (root, tile) != at:
                    if len(held) > 1:
                        yield from settled()
                    at, held = (root, tile), {}
                held[row[0]] = row[1], row[2]
        if len(held) > 1:
            yield from settled()

    return dealt.mapInArrow(each, "a long, b long")


def keys(docs: DataFrame) -> tuple[Column, Column, Column]:
    """id, h1 and h2 of a row: its number, and 128 bits of its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")


def sketched(docs: DataFrame) -> DataFrame:
    """(id, h1, h2, n, p0, p1, p2) of every row: how many shingles, and the print."""
    rows = docs.select(*keys(docs), F.col("text").cast("string").alias("text"))
    names = [f"p{k}" for k in range(PRINT_WORDS)]

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [shingles(t) for t in common.raw(batch)]
        words = np.stack([print_of(h) for h in made]).view(np.int64)
        cols = [batch.column(c) for c in ("id", "h1", "h2")]
        return pa.RecordBatch.from_arrays([*cols, pa.array([len(h) for h in made], pa.int64()), *(pa.array(words[:, k]) for k in range(PRINT_WORDS))], ["id", "h1", "h2", "n", *names])

    return common.map_batches(rows, fn, "id long, h1 long, h2 long, n long, " + ", ".join(f"{n} long" for n in names))


def shingled(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``members``, which have (id, h1, h2, node, root, ...), with the shingles of one row that has their text; a repeated row gives a repeated one."""
    rest = [c for c in members.columns if c not in ("id", "h1", "h2")]
    joined = docs.select(*keys(docs), F.col("text").cast("string").alias("text")).join(members, ["id", "h1", "h2"]).select(*rest, "text")
    kinds = ", ".join(f"{n} {t}" for n, t in members.select(*rest).dtypes)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array([shingles(t).tobytes() for t in common.raw(batch)], pa.binary())], [*rest, "shingles"])

    return common.map_batches(joined, fn, f"{kinds}, shingles binary")


def central(members: DataFrame) -> DataFrame:
    """(root, leader): the member whose print is nearest to what most prints of its block have, bit by bit."""
    names = [f"p{k}" for k in range(PRINT_WORDS)]
    bits = [F.sum(F.shiftrightunsigned(p, b).bitwiseAND(F.lit(1))).alias(f"{p}_{b}") for p in names for b in range(64)]
    most = members.groupBy("root").agg(F.count("*").alias("m"), *bits)
    word = lambda p: sum((F.when(2 * F.col(f"{p}_{b}") > F.col("m"), F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)) for b in range(64)), F.lit(0))
    middle = most.select("root", *(word(p).alias(f"c{p}") for p in names))
    apart = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"c{p}"))) for p in names), F.lit(0))
    return members.join(middle, "root").groupBy("root").agg(F.min_by("node", F.struct(apart.alias("d"), "node")).alias("leader"))


def crowd_tiles(docs: DataFrame, big: DataFrame, scratch: common.Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows for ``tiled``, edges) of large blocks: what is similar to the block's central text is linked to it at once, and only
    compared with the rest; the rest is compared with all. Both are dealt over tiles of bounded size."""
    big = scratch.written(big, "crowd")
    sets = scratch.written(shingled(docs, big.drop("p0", "p1", "p2", "n")).dropDuplicates(["node"]), "crowd-sets")
    leader = central(big)
    heads = sets.join(leader.select(F.col("leader").alias("node")), "node", "left_semi").select("root", F.col("node").alias("leader"), F.col("shingles").alias("head"))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        near = []
        for x, y in zip(batch.column("shingles").to_pylist(), batch.column("head").to_pylist(), strict=True):
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            shared = len(np.intersect1d(a, b, assume_unique=True))
            near.append(shared >= SIMILARITY * (len(a) + len(b) - shared))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("root", "node", "leader")), pa.array(near)], ["root", "node", "leader", "near"])

    told = scratch.written(common.map_batches(sets.join(heads, "root"), fn, "root long, node long, leader long, near boolean"), "crowd-near")
    edges = told.filter("near AND node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))
    weight = big.select("node", "n").join(told, "node").groupBy("root", "near").agg(F.greatest(F.ceil(F.count("*") / TILE_NODES), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int").alias("k"))
    weight = weight.groupBy("root").agg(F.coalesce(F.max(F.when(~F.col("near"), F.col("k"))), F.lit(0)).alias("rest"), F.coalesce(F.max(F.when(F.col("near"), F.col("k"))), F.lit(0)).alias("copies"))
    weight = weight.filter("rest > 0")
    share = lambda c: F.pmod(F.xxhash64("node"), F.greatest(F.col(c), F.lit(1))).cast("int")
    each = told.join(weight, "root").withColumn("own", F.when(F.col("near"), F.col("rest") + share("copies")).otherwise(share("rest")))
    others = F.sequence(F.lit(0), F.when(F.col("near"), F.col("rest") - 1).otherwise(F.col("rest") + F.col("copies") - 1))
    each = each.select("root", "node", (~F.col("near")).alias("asked"), "own", "rest", "copies", F.explode(others).alias("other"))
    tile = F.least("own", "other").cast("long") * (F.col("rest") + F.col("copies")) + F.greatest("own", "other")
    return each.select("root", "node", "asked", tile.alias("tile")).join(sets.select("node", "shingles"), "node"), edges


def groups(docs: DataFrame, scratch: common.Scratch) -> tuple[DataFrame, DataFrame]:
    """(nodes, members): nodes is (node, id, h1, h2, ...), one for each text; members is (node, root) of those with near duplicates."""
    seen = sketched(docs)
    one = seen.groupBy("h1", "h2").agg(F.min("id").alias("id"), *(F.min(c).alias(c) for c in ("n", *(f"p{k}" for k in range(PRINT_WORDS)))))
    nodes = scratch.written(one.withColumn("node", F.monotonically_increasing_id()), "nodes")
    blocks = scratch.written(simhash.components(candidates(nodes.filter("n > 0"))), "blocks")
    held = nodes.join(blocks.select(F.col("fp").alias("node"), "root"), "node")
    size = held.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / TILE_NODES), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int").alias("tiles"), F.count("*").alias("m"))
    held = scratch.written(held.join(size.select("root", ((F.col("tiles") > 1) & (F.col("m") > 2)).alias("big")), "root"), "members")
    names = ["node", "root", "id", "h1", "h2"]
    small = shingled(docs, held.filter("NOT big").select(*names)).select("*", F.lit(True).alias("asked"), F.lit(0).cast("long").alias("tile"))
    links = scratch.written(tiled(small), "links")
    found = links.select(F.col("b").alias("node"), F.col("a").alias("root"))
    big = held.filter("big").drop("big")
    if not big.isEmpty():
        tiles, edges = crowd_tiles(docs, big, scratch)
        found = found.unionByName(simhash.components(edges.unionByName(tiled(tiles))).select(F.col("fp").alias("node"), "root"))
    return nodes, found


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near duplicates."""
    scratch, key = common.Scratch(docs.sparkSession), F.struct("id", "h1", "h2")
    nodes, found = groups(docs, scratch)
    placed = nodes.join(found, "node", "left").select(key.alias("key"), F.coalesce("root", "node").alias("root"))
    chosen = common.written(placed.groupBy("root").agg(F.min("key").alias("key")).select("key.*"), "chosen")
    scratch.spent()
    own = [common.free_name(docs, f"_{c}") for c in ("id", "h1", "h2")]
    tagged = docs.select("*", *(k.alias(n) for k, n in zip(keys(docs), own, strict=True)))
    kept = tagged.join(chosen.toDF(*own), own, "left_semi")
    return kept.dropDuplicates(own).select(*docs.columns)
