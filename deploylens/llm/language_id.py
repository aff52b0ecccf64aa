"""Language identification by nearest centroid.

A text is the normalised TF-IDF vector of its hashed byte n-grams (1 to 3 bytes, letters folded to lower case,
everything in ASCII that is no letter to one blank). Each language has a few centroids, clustered from a
bounded sample of its labelled rows; a text takes the language of the centroid with the largest cosine. It
is rejected where it has no letter, or where its distance to the nearest centroid is larger than any
training text of about its length had, with a margin. Lengths with few training texts take their bound from texts cut
to that length, or from the nearest lengths (``bounds``).

Training takes about ``SAMPLE`` rows in all, dealt evenly over the languages by a hash of doc_id, and ``FEW`` a language at least; prediction reads
whole texts of all rows. Null or letterless texts get ``und`` and score 0. Without any labelled row all get
``und``. Repeated rows get a row each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DIMS = 8192
#: Bound on the labelled rows that training reads, over all languages.
SAMPLE = 4000
CENTROIDS = 3
UNKNOWN = "und"
#: A text is rejected below this share of the least cosine of training texts of its length.
MARGIN = 0.4
#: Training texts that a length needs to have a bound of its own; bytes that they are cut to for the bounds of short texts.
FEW, CUTS = 20, (6, 10, 20, 40)
#: Bytes of a text whose n-grams are counted at once.
BLOCK = 1 << 20

_letter = regex.compile(r"\p{L}").search
_fold = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def ngrams(text: bytes) -> np.ndarray:
    """Counts of the text's n-grams by hash."""
    total = np.zeros(DIMS, np.int64)
    folded = b" " + b" ".join(text.translate(_fold).split()) + b" "
    for at in range(0, len(folded), BLOCK):
        x = np.frombuffer(folded[at : at + BLOCK + 2], np.uint8).astype(np.uint32)
        n = min(BLOCK, len(folded) - at)
        codes = [x[:n] + np.uint32(1)]
        if len(x) > 1:
            two = (x[:-1] << np.uint32(8) | x[1:]) + np.uint32(1 << 16)
            codes.append(two[:n])
        if len(x) > 2:
            codes.append(((x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]) + np.uint32(1 << 24))[:n])
        for c in codes:
            total += np.bincount((c * np.uint32(2654435761)) >> np.uint32(19), minlength=DIMS)
    return total


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    #: Least cosine by the power of two of the length.
    least: np.ndarray

    def score(self, counts: np.ndarray) -> tuple[int, float, bool]:
        """(language, cosine, rejected)."""
        at = np.flatnonzero(counts)
        v = np.log1p(counts[at]) * self.idf[at]
        norm = float(np.sqrt(v @ v))
        if not norm:
            return 0, 0.0, True
        cos = self.centroids[:, at] @ v / norm
        best = int(np.argmax(cos))
        c = min(1.0, max(0.0, float(cos[best])))
        return int(self.owner[best]), c, c < MARGIN * self.least[min(int(counts.sum()).bit_length(), 39)]


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means: the first centre is the mean, each further one starts from the vector farthest from all."""
    unit = lambda c: c / np.maximum(np.linalg.norm(c, axis=-1, keepdims=True), 1e-12)
    centres = unit(x.mean(0))[None]
    while len(centres) < min(k, len(x)):
        centres = np.concatenate([centres, x[[int(np.argmin((x @ centres.T).max(1)))]]])
    for _ in range(rounds):
        member = (np.argmax(x @ centres.T, 1)[None] == np.arange(len(centres))[:, None]).astype(x.dtype)
        centres = np.where(member.any(1)[:, None], unit(member @ x), centres)
    return centres


def bounds(cos: np.ndarray, length: np.ndarray, short: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Least cosine by the power of two of the length. Where training saw fewer than ``FEW`` texts of a length, what
    all but a hundredth of the training texts cut to that length reach; for longer ones, the lesser of the two nearest lengths."""
    least, filled = np.zeros(40), np.flatnonzero(np.bincount(length, minlength=40) >= FEW)
    if len(filled):
        least[:] = [min(cos[length == f].min() for f in filled[np.argsort(np.abs(filled - b), kind="stable")[:2]]) for b in range(40)]
    cut: dict[int, list[float]] = {}
    for at, n in short:
        v = np.log1p(n) * idf[at]
        cut.setdefault(int(n.sum()).bit_length(), []).append(float((centroids[:, at] @ v).max() / max(float(np.sqrt(v @ v)), 1e-12)))
    for b, found in cut.items():
        if len(found) >= FEW and b not in filled:
            least[b] = np.quantile(found, 0.01)
    if cut:  # still shorter ones have less to go by
        least[: min(cut)] = 0.0
    for b in filled:
        least[b] = cos[length == b].min()
    return least


def train(labelled: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model | None:
    """The model from rows of doc_id, text and lang."""
    labelled = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    quota = max(FEW, sample // len(counts))  # no language is left out, however many there are
    shares = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, quota / n))))
    share = F.coalesce(F.try_element_at(shares, F.col("lang")), F.lit(0.0))
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = labelled.filter(place < share).select("doc_id", "lang", "text")

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, lang = common.raw(batch), batch.column("lang").to_pylist()
        parts = [(k, t[:n]) for n in CUTS for k, t in enumerate(texts) if len(t) > n and _letter(t[:n].decode("utf-8", "replace"))]
        made = [ngrams(t) for t in texts] + [ngrams(t) for _, t in parts]
        lang, cut = lang + [lang[k] for k, _ in parts], [False] * len(texts) + [True] * len(parts)
        at = [np.flatnonzero(c).astype(np.int16) for c in made]
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(cut), pa.array([a.tobytes() for a in at]), pa.array([c[a].astype(np.int32).tobytes() for c, a in zip(made, at, strict=True)])], ["lang", "cut", "at", "n"])

    found = common.map_batches(chosen, fn, "lang string, cut boolean, at binary, n binary").collect()
    rows = sorted((r for r in found if not r["cut"]), key=lambda r: r["lang"])  # a language is a slice
    short = [(np.frombuffer(r["at"], np.int16), np.frombuffer(r["n"], np.int32)) for r in found if r["cut"]]
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return None
    x = np.zeros((len(rows), DIMS), np.float32)  # the one large array: all that follows changes it where it lies
    for k, r in enumerate(rows):
        x[k, np.frombuffer(r["at"], np.int16)] = np.frombuffer(r["n"], np.int32)
    sizes = x.sum(1, dtype=np.float64).astype(np.int64)
    idf = np.log((1 + len(rows)) / (1 + np.count_nonzero(x, axis=0))).astype(np.float32) + np.float32(0.1)
    np.log1p(x, out=x)
    x *= idf
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]
    edges = np.searchsorted([r["lang"] for r in rows], [*langs, chr(0x10FFFF)])
    del found, rows
    made = [cluster(x[a:b], centroids) for a, b in zip(edges, edges[1:], strict=False)]
    all_c, owner = np.concatenate(made), np.repeat(np.arange(len(langs)), [len(c) for c in made])
    cos = (x @ all_c.T).max(1)
    length = np.array([int(n).bit_length() for n in sizes])
    return Model(langs, idf, all_c.astype(np.float32), owner, bounds(cos, length, short, idf, all_c))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` rows as doc_id, lang_pred, score, rejected."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score, rejected = [], [], []
        for text in common.raw(batch):
            if model is None or not _letter(text.decode("utf-8", "replace")):
                lang.append(UNKNOWN)
                score.append(0.0)
                rejected.append(True)
                continue
            k, c, out = model.score(ngrams(text))
            lang.append(model.langs[k])
            score.append(c)
            rejected.append(bool(out))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return common.map_batches(common.doc_texts(docs), fn, "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` without the rejected rows; a null lang takes the predicted one. Without a model, no text with a
    letter is rejected."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, keep = batch.column("lang").to_pylist(), []
        for k, text in enumerate(common.raw(batch)):
            ok = bool(_letter(text.decode("utf-8", "replace")))
            if ok and model is not None:
                best, _, out = model.score(ngrams(text))
                ok = not out
                lang[k] = model.langs[best] if lang[k] is None else lang[k]
            keep.append(ok)
        cols = [pa.array(lang, pa.string()) if c == "lang" else batch.column(c) for c in batch.schema.names]
        return pa.RecordBatch.from_arrays(cols, batch.schema.names).filter(pa.array(keep, pa.bool_()))

    return common.map_batches(docs, fn, docs.schema)


def fold(parts: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def identify(docs: DataFrame, held_fold: int = 2, folds: int = 4) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; learnt from the rows outside the held-out fold."""
    model = train(docs.filter(fold(folds) != held_fold))
    held = F.coalesce(fold(folds) == held_fold, F.lit(False)).alias("held_out")
    return predict(docs, model).select("doc_id", held, "lang_pred", "score", "rejected")
