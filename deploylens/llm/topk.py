"""Exact top-k inner products by pivot-table elimination.

Vectors are quantised to integers, so scores are exact. A few rows, chosen by a hash, are the pivots; each row has its
distances to all of them; by the triangle inequality the distance of a query to a row is at least the
largest difference of their distances to a pivot, and with the two lengths that bounds the score from
above. Rows of a block are evaluated in the order of that bound until it falls below the k-th score
found so far, which ends the block with nothing missed.

Rows are packed into blocks of bounded size, with their distances to the pivots beside them, computed once and kept in
steps of a byte; components take a byte or two where they fit. Every group of queries meets every block of rows by its number, shuffled and streamed, so neither side is ever held whole; a block none of whose
bounds reaches the k-th scores found before costs no evaluation.

Vectors that are null, or hold null or non-finite components, take no part; nor do rows without a vec_id, and a
row whose length differs from a query's is no candidate of it. Rows that share a vec_id are candidates
each, but not of the query with that vec_id, which is asked once (with the smallest vector). Ties go to
the smaller vec_id. Components and scores beyond 64 bits (components of some 1e17 and more) are taken as the
largest number of their sign, and rank as such. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SCALE = 64
QUERY_STEP = 20
#: The largest score.
TOP = 2**63 - 1
K = 20
#: Rows that serve as pivots.
PIVOTS = 64
#: Vectors of a block of rows, and of a block of queries.
ROW_BLOCK, QUERY_BLOCK = 2048, 256
#: Candidates evaluated before the first look at the bound; each further look comes after twice as many.
CHUNK = 512


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and x, the vector as floor(scale * component), of the rows that take part."""
    e = F.col("embedding")
    whole = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    x = F.transform(e, lambda v: F.greatest(F.floor(F.lit(float(scale)) * v.cast("double")).cast("long"), F.lit(-TOP)))
    return vectors.filter(F.col("vec_id").isNotNull() & e.isNotNull() & whole).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def pivots(rows: DataFrame, count: int = PIVOTS) -> dict[int, np.ndarray]:
    """By dimension: ``count`` rows in all, those with the smallest hashes."""
    found: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(count).collect():
        found.setdefault(len(r["x"]), []).append(r["x"])
    return {dim: np.array(x, float).reshape(len(x), dim) for dim, x in found.items()}


def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots, a row a pivot."""
    return np.sqrt(np.maximum(0, (p * p).sum(1)[:, None] - 2 * p @ x.T + (x * x).sum(1)[None, :])).astype(np.float32)


def block_topk(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, rd: np.ndarray, k: int, pivot: np.ndarray, least: np.ndarray | None = None, rough: float = 0.0) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query, (vec_id, score) of the k best rows of this block, best first, ties to the smaller id. ``rd`` has the rows' distances to the
    pivots, a row a pivot, which may be ``rough`` off. Rows that score below ``least``, what the query's k-th row elsewhere scores, may be left out.

    Rows are evaluated by chunks in the order of their bounds: the best chunk first, then those whose bound still reaches the k-th
    score. Products of quantised components are summed in floats only where they stay below 2**52, so they are exact."""
    big = max(np.abs(rows).max(initial=0), np.abs(queries).max(initial=0))
    exact = float(big) ** 2 * max(rows.shape[1], 1) < 2**52
    q, r = (queries.astype(float), rows.astype(float)) if exact else (queries.astype(object), rows.astype(object))
    qf, rf = queries.astype(float), rows.astype(float)
    qd = distances(qf, pivot).T
    qn, rn = (qf * qf).sum(1), (rf * rf).sum(1)
    slack = 1e-6 * (qd.max(initial=0) + rd.max(initial=0)) + 1e-6 + rough  # rounding never eliminates
    apart, far = np.empty_like(rd), np.zeros(len(r), np.float32)
    out = []
    for i in range(len(q)):
        if len(pivot):
            np.subtract(rd, qd[i][:, None], out=apart)
            np.abs(apart, out=apart)
            far = apart.max(0)
        least_far = np.maximum(far.astype(float) - slack, 0)
        bound = (qn[i] + rn - least_far * least_far) / 2 + 1e-9 * (rn + qn[i]) + 1e-6
        bound[row_ids == query_ids[i]] = -np.inf
        kth = -np.inf if least is None else least[i]
        best_s, best_id = np.zeros(0, float if exact else np.int64), np.zeros(0, np.int64)
        left = np.flatnonzero(bound >= kth) if np.isfinite(kth) else np.flatnonzero(bound > -np.inf)
        size = CHUNK
        while len(left):
            if len(left) > size:
                split = np.argpartition(-bound[left], size - 1)
                own, left = left[split[:size]], left[split[size:]]
            else:
                own, left = left, left[:0]
            size *= 2
            made = (r @ q[i])[own] if exact and 2 * len(own) > len(r) else r[own] @ q[i]
            if not exact:
                made = np.array([min(TOP, max(-TOP, int(v))) for v in made], np.int64)
            if len(made) > 4 * k:  # the rest can't be among the k, ties included
                near = np.flatnonzero(made >= np.partition(made, len(made) - k)[len(made) - k])
                own, made = own[near], made[near]
            s, ids = np.concatenate([best_s, made]), np.concatenate([best_id, row_ids[own]])
            top = np.lexsort((ids, -s))[:k]
            best_s, best_id = s[top], ids[top]
            if len(best_s) == k:
                left = left[bound[left] >= max(kth, best_s[-1])]
        out.append((best_id, best_s.astype(np.int64)))
    return out


def blocks(vectors: DataFrame, size: int, pivot: dict[int, np.ndarray]) -> DataFrame:
    """(n, dim, step, ids, data, far): rows of one dimension packed as bytes, ``size`` at most, where they lie, with the table of their distances
    to the pivots in whole steps."""

    def each(batches):
        held: dict[int, tuple[list[int], list[list[int]]]] = {}

        def packed(dim):
            ids, xs = held.pop(dim)
            x = np.array(xs, np.int64).reshape(len(ids), dim)
            far = distances(x.astype(float), pivot.get(dim, np.zeros((0, dim))))
            step, most = max(1e-9, float(far.max(initial=0)) / 255), np.abs(x).max(initial=0)
            kind = next(k for k, top in (("<i1", 2**7), ("<i2", 2**15), ("<i8", np.inf)) if most < top)
            cols = [pa.array([len(ids)], pa.int32()), pa.array([dim], pa.int32()), pa.array([step]), *(pa.array([v.tobytes()], pa.binary()) for v in (np.array(ids, "<i8"), x.astype(kind), np.floor(far / step).astype(np.uint8)))]
            return pa.RecordBatch.from_arrays(cols, ["n", "dim", "step", "ids", "data", "far"])

        for batch in batches:
            for i, x in zip(batch.column("vec_id").to_pylist(), batch.column("x").to_pylist(), strict=True):
                ids, xs = held.setdefault(len(x), ([], []))
                ids.append(i)
                xs.append(x)
                if len(ids) == size:
                    yield packed(len(x))
        for dim in list(held):
            yield packed(dim)

    return vectors.mapInArrow(each, "n int, dim int, step double, ids binary, data binary, far binary")


def exact_topk(queries: DataFrame, rows: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) for quantised ``queries`` against quantised ``rows``."""
    spark = rows.sparkSession
    queries = queries.groupBy("vec_id").agg(F.min("x").alias("x"))
    count = queries.count()
    groups = max(1, -(-count // QUERY_BLOCK))
    asked = queries.withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int"))
    pivot = pivots(rows)
    held = common.written(blocks(rows, ROW_BLOCK, pivot), "vectors")
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lanes = max(1, -(-tasks // groups))
    # each block of rows goes once to each group of queries; a lane takes a share of the blocks
    lane = F.pmod(F.xxhash64("ids"), F.lit(lanes)).cast("int")
    sent = held.select("*", lane.alias("lane"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    sent = sent.select("g", "lane", F.lit(1).alias("side"), "dim", "step", "ids", "data", "far")
    flat = F.transform("x", lambda v: v)
    own = asked.select("g", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.col("vec_id"), flat.alias("x"))
    own = own.select("g", "lane", F.lit(0).alias("side"), F.size("x").alias("dim"), "vec_id", "x")
    both = own.unionByName(sent, allowMissingColumns=True).repartition(tasks, "g", "lane").sortWithinPartitions("g", "lane", "side")

    def each(batches):
        """Queries of a (group, lane) come first, then its blocks of rows, one at a time."""
        at, asked_by, best = None, {}, {}

        def done():
            rows = [(q, i, s) for q, (ids, ss) in best.items() for i, s in zip(ids.tolist(), ss.tolist(), strict=True)]
            best.clear()
            if rows:
                q, i, s = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.int64())], ["query_id", "vec_id", "score"])

        for batch in batches:
            cols = {c: batch.column(c) for c in batch.schema.names}
            for n in range(batch.num_rows):
                key = cols["g"][n].as_py(), cols["lane"][n].as_py()
                if key != at:
                    yield from done()
                    at, asked_by = key, {}
                dim = cols["dim"][n].as_py()
                if cols["side"][n].as_py() == 0:
                    asked_by.setdefault(dim, []).append((cols["vec_id"][n].as_py(), cols["x"][n].as_py()))
                    continue
                if dim not in asked_by:
                    continue
                if isinstance(asked_by[dim], list):
                    asked_by[dim] = np.array([i for i, _ in asked_by[dim]], np.int64), np.array([x for _, x in asked_by[dim]], np.int64).reshape(len(asked_by[dim]), dim)
                qi, q = asked_by[dim]
                ids = np.frombuffer(cols["ids"][n].as_py(), "<i8")
                least = np.array([best[i][1][-1] if i in best and len(best[i][1]) == k else -np.inf for i in qi.tolist()])
                data, own = cols["data"][n].as_py(), pivot.get(dim, np.zeros((0, dim)))
                x = np.frombuffer(data, f"<i{len(data) // max(1, dim * len(ids)) or 8}").astype(np.int64).reshape(len(ids), dim)
                step = cols["step"][n].as_py()
                far = (np.frombuffer(cols["far"][n].as_py(), np.uint8).reshape(len(own), len(ids)).astype(np.float32) + np.float32(0.5)) * np.float32(step)
                found = block_topk(q, qi, x, ids, far, k, own, least, step)
                for one, (i, s) in zip(qi.tolist(), found, strict=True):
                    if one in best:
                        i, s = np.concatenate([best[one][0], i]), np.concatenate([best[one][1], s])
                        top = np.lexsort((i, -s))[:k]
                        i, s = i[top], s[top]
                    best[one] = i, s
        yield from done()

    found = both.mapInArrow(each, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, k: int = K, step: int = QUERY_STEP) -> DataFrame:
    """Every row whose vec_id is divisible by ``step`` against all other rows."""
    rows = quantised(vectors)
    return exact_topk(rows.filter(F.col("vec_id") % step == 0), rows, k)
