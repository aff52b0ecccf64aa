"""Spelling variants: words one edit from a much more frequent word, found by asymmetric q-chunks.

A word is in turn the one that is asked for its neighbours and the one that is offered as one. Asked, it is cut into two disjoint chunks; offered, it gives
the grams as long as these chunks would be. One edit leaves a chunk whole, and by one place at most is it shifted: the left chunk
stands where it stood, the right one is moved by the difference of the lengths. So only the grams at those places are sent, under the length they offer themselves to, and
words meet under chunk, side and length. What meets is verified by its rest alone: rests with one place masked or taken out are looked up, so
a group takes time in proportion to its words and no pairs are formed but those that are neighbours. A pair whose two chunks are both whole
counts on the left side only.

Groups of very many words (a common stem, say) are dealt anew by the same method: their rests are cut into chunks and grams, until a group is small
or the rest is one letter, of which there are few. A group gives a row for each word that has neighbours in it, with their
number and the best of them.

Words are maximal runs of Latin letters, of which A-Z are lower-cased. Null and empty texts have none. A null doc_id counts as an empty number.
Repeated rows count each. Very long texts and very long runs are taken whole. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Code points of a word, and how often it occurs, at least.
LETTERS, LEAST = 5, 3
#: A form occurs so many times as often as its variant.
RATIO = 2
#: Words counted in a task before the counts leave it.
HELD_WORDS = 200_000
#: Words of a group that a task takes at once; groups with more are dealt anew.
GROUP_WORDS = 20_000
#: A-Z come lower-cased; in UTF-8, U+00C0 to U+00FF have this lead byte and no other characters do.
_RUN = re.compile(rb"(?:[a-z]+|(?:\xc3[\x80-\xbf])+)+")

# words ---------------------------------------------------------------------------------------


def words_of(text: bytes, doc_id: int | None, letters: int = LETTERS) -> Counter:
    """Words of a text and how often they occur. By a hash of the text's number and the word, a few words lose a letter."""
    out: Counter = Counter()
    own = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
    for run, n in Counter(_RUN.findall(text.lower())).items():
        if len(run) < letters:
            continue
        h = zlib.crc32(run, own)
        word = run.decode()
        if h % 97 == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        if len(word) >= letters:
            out[word] += n
    return out


def counts(docs: DataFrame, letters: int = LETTERS, least: int = LEAST) -> DataFrame:
    """(word, n) of the words that occur often enough."""

    def each(batches):
        held: Counter = Counter()

        def made():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for whole in batches:
            for at in range(0, whole.num_rows, common.BATCH_ROWS):
                batch = whole.slice(at, common.BATCH_ROWS)
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), common.raw(batch), strict=True):
                    held.update(words_of(text, doc_id, letters))
                    if len(held) >= HELD_WORDS:
                        yield made()
        if held:
            yield made()

    parts = common.doc_texts(docs).mapInArrow(each, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


# meeting -------------------------------------------------------------------------------------

#: key: what a group has in common; path: sides of the chunks so far; asked or offered; lo and hi: where the word's rest is; size: length of the rest of
#: those asked, one number for a group.
MEETING = "key long, path string, asked boolean, word string, n long, lo int, hi int, size int"


def split(size: int) -> int:
    """Length of the left chunk."""
    return (size + 1) // 2


def meetings(key: int, path: str, asked: bool, word: str, lo: int, hi: int, sizes: list[int]) -> list[tuple]:
    """(key, path, lo, hi, size) of the groups that a word's rest goes to, asked (of length sizes[0]) or offered to rests of ``sizes``."""
    out = []
    for size in sizes:
        a = split(size)
        for side, q, at in (("a", a, lo), ("b", size - a, hi - size + a)):
            if q > hi - lo:
                continue
            own = xxhash.xxh3_64_intdigest(f"{key}{side}{size} {word[at : at + q]}".encode())
            own -= own >> 63 << 64
            out.append((own, path + side, lo + a, hi, size - a) if side == "a" else (own, path + side, lo, at, a))
    return out


def dealt(rows: DataFrame, first: bool, letters: int = LETTERS) -> DataFrame:
    """``rows`` of ``MEETING`` (of which the ``first`` have no group yet: word and n) under the keys of their chunks and grams."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        if first:
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                m = len(word)
                out += [(*g[:2], True, word, n, *g[2:]) for g in meetings(0, "", True, word, 0, m, [m])]
                out += [(*g[:2], False, word, n, *g[2:]) for g in meetings(0, "", False, word, 0, m, [s for s in (m - 1, m, m + 1) if s >= letters])]
        else:
            for key, path, asked, word, n, lo, hi, size in zip(*(batch.column(f.split()[0]).to_pylist() for f in MEETING.split(", ")), strict=True):
                out += [(*g[:2], asked, word, n, *g[2:]) for g in meetings(key, path, asked, word, lo, hi, [size])]
        if not out:
            return None
        kinds = (pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [f.split()[0] for f in MEETING.split(", ")])

    return common.map_batches(rows, fn, MEETING, rows=4096)


def first_side(x: str, y: str, path: str) -> bool:
    """Whether a pair that meets on ``path`` met nowhere left of it."""
    lo, hx = 0, len(x)
    for side in path:
        a = split(hx - lo)
        if (x[lo : lo + a] == y[lo : lo + a]) != (side == "a"):
            return False
        if side == "a":
            lo += a
        else:
            hx = lo + a
    return True


def neighbours(asked: list[tuple], offered: list[tuple], path: str) -> dict[str, list]:
    """By word asked: how many of those offered are one edit away, and the best one's n and name. Rows are (word, n, lo, hi, size)."""
    found: dict[str, list] = {}

    def met(x: str, y: str, n: int) -> None:
        if first_side(x, y, path):
            own = found.setdefault(x, [0, n, y])
            own[0] += 1
            if (-n, y) < (-own[1], own[2]):
                own[1:] = n, y

    masked: dict[str, list[tuple[str, int]]] = {}
    shorter: dict[str, int] = {}
    words = {r[0] for r in asked}
    for y, n, lo, hi, size in offered:
        if hi - lo == size:
            for i in range(lo, hi):
                masked.setdefault(f"{y[:i]}\0{y[i + 1 :]}", []).append((y, n))
        elif hi - lo < size:
            shorter[y] = n
        else:
            for x in {y[:i] + y[i + 1 :] for i in range(lo, hi)} & words:
                met(x, y, n)
    for x, _, lo, hi, _ in asked:
        for i in range(lo, hi):
            for y, n in masked.get(f"{x[:i]}\0{x[i + 1 :]}", ()):
                if y != x:
                    met(x, y, n)
        for y in {x[:i] + x[i + 1 :] for i in range(lo, hi)} & shorter.keys():
            met(x, y, shorter[y])
    return found


def met(rows: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best): a row for each word and group of ``rows`` in which it has neighbours."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = rows.repartition(n, "key").sortWithinPartitions("key")

    def each(batches):
        out: list[tuple] = []

        def made():
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, ["word", "n_near", "best_n", "best"])

        for _, cols in common.groups_of(batches, "key", ("path", "asked", "word", "n", "lo", "hi", "size")):
            if len(cols[0]) < 2:
                continue
            path, asked, *rest = (c.tolist() for c in cols)
            sides: dict[str, tuple[list, list]] = {}  # keys are hashes: paths are told apart
            for p, a, row in zip(path, asked, zip(*rest, strict=True), strict=True):
                sides.setdefault(p, ([], []))[not a].append(row)
            for p, (xs, ys) in sides.items():
                out += [(x, *v) for x, v in neighbours(xs, ys, p).items()]
            if len(out) > 5000:
                yield made()
        if out:
            yield made()

    return grouped.mapInArrow(each, "word string, n_near long, best_n long, best string")


def near_words(words: DataFrame, scratch: common.Scratch, letters: int = LETTERS, group: int = GROUP_WORDS) -> DataFrame:
    """(word, n_near, best_n, best) of the words of (word, n) that have others one edit away."""
    rows, first, parts = words, True, []
    while True:
        rows = scratch.written(dealt(rows, first, letters), "meetings")
        many = rows.groupBy("key").agg(F.count("*").alias("rows"), F.max("size").alias("longest")).filter((F.col("rows") > group) & (F.col("longest") > 1)).select("key")
        many = scratch.written(many, "crowded")
        if many.isEmpty():
            parts.append(met(rows))
            break
        parts.append(met(rows.join(many, "key", "left_anti")))
        rows, first = rows.join(many, "key", "left_semi"), False
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    best = F.min(F.struct((-F.col("best_n")).alias("best_n"), "best")).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.best_n")).alias("best_n"), "b.best")


def roots(forms: DataFrame, scratch: common.Scratch) -> DataFrame:
    """(word, root): the ends of the forms' chains in (word, form), by jumping. A form occurs twice as often as its variant, so chains are short."""
    at = scratch.written(forms.select("word", F.col("form").alias("root")), "jumps")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = scratch.written(at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "jumps")
        scratch.spent(at)
        if jumped.filter("moved").isEmpty():
            return jumped.select("word", "root")
        at = jumped


def variants(words: DataFrame, letters: int = LETTERS, ratio: int = RATIO, group: int = GROUP_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of the different words of (word, n)."""
    scratch = common.Scratch(words.sparkSession)
    words = scratch.written(words, "words")
    near = near_words(words, scratch, letters, group)
    counts = F.col("best_n") >= ratio * F.col("n")
    rated = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(counts, F.col("best")).alias("form"), F.when(counts, F.col("best_n")).alias("form_n"))
    rated = common.written(rated, "rated")
    ends = common.written(roots(rated.filter("form IS NOT NULL"), scratch), "roots")
    scratch.spent()
    return rated.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_variants(docs: DataFrame) -> DataFrame:
    """The same of the words of documents."""
    return variants(counts(docs))
