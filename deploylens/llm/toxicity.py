"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

A lexicon of words and word beginnings is learnt first, by how much likelier they are in toxic texts. A text is then a
short row of numbers: lexicon densities (plain, by beginning, and after undoing character substitutions), how
near they stand to a second person, capitals, punctuation and obfuscation rates. Trees are boosted on
those, and the scores of rows that the trees have not seen calibrate them by isotonic regression.

Training takes at most ``SAMPLE`` labelled rows (half for the lexicon, the rest for trees and calibration), chosen by
a hash of doc_id within each label; calibration weighs each by the labels it stands for, so that scores mean the same
at every size. Scoring reads whole texts of all rows. Null texts count as empty. Rows
whose doc_id is null or has no label are scored, not learnt from; a doc_id with several labels counts as toxic
if any says so. With labels of one kind only, or none, every score is that kind's (0 without any).
Repeated rows get a row each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bound on the labelled rows that training reads.
SAMPLE = 16_000
#: Word beginnings the lexicon may hold, by length; and its largest size.
PREFIXES, LEXICON = (4, 5, 6, 7), 3000
TREES, DEPTH, RATE, BINS = 80, 3, 0.15, 32
#: Words between a lexicon word and a second person that count as near.
NEAR = 5
#: Second persons of common languages. Fixed values.
SECOND_PERSON = frozenset("you your yours yourself ya u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deiner ihr euch euer sie usted ustedes tú ti tus vosotros".split())
#: Characters that stand for letters in disguised words. Fixed values.
DISGUISE = str.maketrans("013457@$!", "oieastasi")

_words = regex.compile(r"[\p{L}\p{N}@$!*_'-]+").findall
_odd = regex.compile(r"\p{L}[\p{N}@$*_!]+\p{L}").search
_strip = regex.compile(r"[*_'!-]+")
_upper = regex.compile(r"\p{Lu}").findall
_letters = regex.compile(r"\p{L}").findall
_points = regex.compile(r"[.,;:!?]").findall


@dataclass
class Lexicon:
    words: dict[str, float] = field(default_factory=dict)
    starts: dict[str, float] = field(default_factory=dict)


def bare(word: str) -> str:
    return _strip.sub("", word)


def terms(text: str) -> set[str]:
    """Words, and beginnings marked by a closing dash."""
    words = {bare(w) for w in _words(text.lower())}
    return words | {f"{w[:n]}-" for w in words for n in PREFIXES if len(w) > n}


def features(text: str, lexicon: Lexicon) -> list[float]:
    tokens = _words(text)
    low = [t.lower() for t in tokens]
    n = max(1, len(low))
    plain = [lexicon.words.get(w) or lexicon.words.get(bare(w)) or 0.0 for w in low]
    starts = [0.0] * len(low)
    if lexicon.starts:
        get = lexicon.starts.get
        starts = [max(get(w[:4], 0.0), get(w[:5], 0.0), get(w[:6], 0.0), get(w[:7], 0.0)) if len(w) > 4 else 0.0 for w in low]
    odd = [k for k, t in enumerate(tokens) if not t.isalpha() and _odd(t)]
    undone = 0
    for k in odd:
        word = bare(low[k].translate(DISGUISE))
        w = lexicon.words.get(word) or lexicon.words.get(_strip.sub("", low[k])) or 0.0
        undone += bool(w)
        plain[k] = max(plain[k], w)
    hits = [k for k in range(len(low)) if plain[k] or starts[k]]
    weights = [max(plain[k], starts[k]) for k in hits]
    near = 0
    if hits:
        second = [k for k, w in enumerate(low) if w in SECOND_PERSON]
        for k in hits:
            at = bisect_left(second, k)
            near += any(abs(second[j] - k) <= NEAR for j in (at - 1, at) if 0 <= j < len(second))
    densest = max((bisect_left(hits, k + 50) - i for i, k in enumerate(hits)), default=0)
    letters, chars = max(1, len(_letters(text))), max(1, len(text))
    points = _points(text)
    return [
        sum(map(bool, plain)) / n, sum(map(bool, starts)) / n, float(len(hits)), sum(weights) / n, max(weights, default=0.0), float(densest), near / max(1, len(hits)), float(near),
        len(_upper(text)) / letters, sum(t.isupper() and len(t) > 1 for t in tokens) / n, len(points) / chars, (points.count("!") + points.count("?")) / n, len(odd) / n, float(undone), float(np.log1p(len(low))),
    ]


# trees ---------------------------------------------------------------------------------------


@dataclass
class Trees:
    base: float
    #: Of each tree: per inner node (feature, bound), and the leaves' values.
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, bound, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > bound[node])
            out += value[node - len(feature)]
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic boosting of full binary trees over binned features, with second-order leaf values."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)  # bin k: x <= cuts[k]
    p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    made = Trees(float(np.log(p / (1 - p))), [])
    score, inner = np.full(len(y), made.base), 2**DEPTH - 1
    for _ in range(TREES):
        pr = sigmoid(score)
        g, h = y - pr, pr * (1 - pr)
        feature, bound, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(node == k)
                best = 1e-6
                gs, hs = g[rows].sum(), h[rows].sum()
                for j, c in enumerate(cuts):
                    if not len(c) or len(rows) < 20:
                        continue
                    gl = np.cumsum(np.bincount(binned[rows, j], g[rows], len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[rows, j], h[rows], len(c) + 1))[:-1]
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    gain[(hl < 1) | (hs - hl < 1)] = 0
                    if gain.max() > best:
                        best, feature[k], bound[k] = gain.max(), j, c[int(gain.argmax())]
                node[rows] = 2 * k + 1 + (x[rows, feature[k]] > bound[k])
        leaf = node - inner
        value = RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
        score = score + value[leaf]
        made.trees.append((feature, bound, value))
    return made


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y on score, by pooling adjacent violators."""
    order = np.argsort(score, kind="stable")
    weight = np.ones(len(y)) if weight is None else weight
    pools: list[list[float]] = []  # sum, weight, first and last score
    for s, v, w in zip(score[order].tolist(), y[order].tolist(), weight[order].tolist(), strict=True):
        pools.append([v * w, w, s, s])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            v2, w2, _, last = pools.pop()
            pools[-1][0] += v2
            pools[-1][1] += w2
            pools[-1][3] = last
    return np.array([s for p in pools for s in p[2:]]), np.repeat([v / w for v, w, _, _ in pools], 2)


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray] | None
    constant: float = 0.0

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.constant)
        x = np.array([features(t, self.lexicon) for t in texts]).reshape(len(texts), -1)
        return np.clip(np.interp(self.trees.raw(x), *self.knots), 0, 1)


def learn_lexicon(rows: DataFrame, n_toxic: int, n_clean: int) -> Lexicon:
    """Terms whose odds are at least e**2 times higher in toxic texts, from document counts."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        toxic, clean = Counter(), Counter()
        for t, label in zip(common.texts(batch), batch.column("toxic").to_pylist(), strict=True):
            (toxic if label else clean).update(terms(t))
        keys = list(toxic.keys() | clean.keys())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())], ["term", "a", "b"])

    counted = common.map_batches(rows, fn, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    odds = F.log((F.col("a") + 0.5) / (n_toxic + 1)) - F.log((F.col("b") + 0.5) / (n_clean + 1))
    found = counted.filter(F.col("a") >= max(4, n_toxic // 400)).withColumn("odds", odds).filter(F.col("odds") >= 2.0)
    made = Lexicon()
    for r in found.orderBy(F.desc(F.col("odds") * F.log1p("a")), "term").limit(LEXICON).collect():
        if r["term"].endswith("-"):
            made.starts[r["term"][:-1]] = float(r["odds"])
        elif r["term"]:
            made.words[r["term"]] = float(r["odds"])
    return made


def train(docs: DataFrame, known: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from texts (doc_id, text) and labels (doc_id, toxic: 0 or 1). The labels are sampled first, a third of them toxic
    if there are as many; only that sample, never larger than ``sample``, is broadcast to fetch the texts."""
    counts = {int(r["toxic"]): int(r["n"]) for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Model(Lexicon(), None, None, float(next(iter(counts), 0)))
    place = F.xxhash64(F.col("doc_id"), F.lit("toxicity sample"))
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("toxicity part")), F.lit(4)).cast("int").alias("part")
    ids = None
    for label, most in ((1, sample // 3), (0, sample - sample // 3)):
        share = min(1.0, 1.5 * most / counts[label])  # spares the sort most rows
        near = F.pmod(place, F.lit(1 << 30)) < int(share * (1 << 30))
        one = known.filter((F.col("toxic") == label) & near).orderBy(place, "doc_id").limit(most).select("doc_id", F.col("toxic").cast("int").alias("toxic"), part)
        ids = one if ids is None else ids.union(one)
    ids = common.written(ids, "toxicity-ids")
    stands = {int(r["toxic"]): counts[int(r["toxic"])] / r["count"] for r in ids.groupBy("toxic").count().collect()}  # labels that a sampled one stands for
    found = docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic", "part").agg(F.min("text").alias("text"))
    chosen = common.written(found.select("doc_id", "text", "toxic", "part"), "toxicity-sample")
    sized = {(int(r["toxic"]), r["part"] < 2): 0 for r in chosen.groupBy("toxic", "part").count().collect()}
    for r in chosen.groupBy("toxic", "part").count().collect():
        sized[int(r["toxic"]), r["part"] < 2] += r["count"]
    lexicon = learn_lexicon(chosen.filter("part < 2"), sized.get((1, True), 0), sized.get((0, True), 0))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [features(t, lexicon) for t in common.texts(batch)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), batch.column("part"), pa.array(made, pa.list_(pa.float64()))], ["doc_id", "toxic", "part", "x"])

    rows = common.map_batches(chosen.filter("part >= 2"), fn, "doc_id long, toxic int, part int, x array<double>").collect()
    rows.sort(key=lambda r: r["doc_id"])
    x, y, part = np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], float), np.array([r["part"] for r in rows])
    one, two = part == 2, part == 3
    if not (one.any() and two.any() and 0 < y[one].mean() < 1):
        return Model(lexicon, None, None, counts[1] / (counts[0] + counts[1]))
    trees = boost(x[one], y[one])
    trees.base += float(np.log(stands[1] / stands[0]))
    return Model(lexicon, trees, isotonic(trees.raw(x[two]), y[two], np.where(y[two] > 0, stands[1], stands[0])))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(common.texts(batch)), pa.float64())], ["doc_id", "score"])

    return common.map_batches(common.doc_texts(docs), fn, "doc_id long, score double")


def rate(docs: DataFrame, labels: DataFrame, held_fold: int = 0, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted; learnt from the labelled rows outside the held-out fold."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    model = train(common.doc_texts(docs), known.filter(crc != held_fold))
    held = F.coalesce(crc == held_fold, F.lit(False)).alias("held_out")
    return score(docs, model).select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
