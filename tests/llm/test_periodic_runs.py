import hashlib
import random
import zlib
from collections import Counter

from deploylens.llm import periodic_runs


def by_hand(w, exponent=4, least=6):
    """Every maximal stretch of every period; of one stretch the smallest period counts."""
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q):
                found[i, j + q] = min(q, found.get((i, j + q), q))
            i = j + 1
    return sorted(((a, b, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_those_found_by_hand():
    rng = random.Random(1)
    for _ in range(600):
        texts = []
        for _ in range(rng.randint(1, 4)):
            letters = rng.choice([b"ab", b"abc", b"a", b"abcdefghij"])
            w = [bytes([rng.choice(letters)]) for _ in range(rng.randint(0, 60))]
            for _ in range(rng.randint(0, 3) if w else 0):
                a, p = rng.randrange(len(w)), rng.randint(1, 12)
                w[a:a] = w[a : a + p] * rng.randint(2, 8)
            texts.append(w)
        for exponent, least in ((4, 6), (2, 2), (3, 1)):
            assert periodic_runs.runs_of(texts, exponent, least) == [by_hand(w, exponent, least) for w in texts]


def test_long_periods_and_neighbouring_texts():
    block = [b"w%d" % i for i in range(700)]
    alone = [b"x", *block * 4, b"y"]
    assert periodic_runs.runs_of([alone, block * 2, block * 2, [], [b"a"] * 6]) == [[(1, 2801, 700)], [], [], [], [(0, 6, 1)]]


def digest(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = by_hand(words)
    drop = {i for a, b, q in runs for i in range(a + q, b)}
    best = max(runs, key=lambda r: (r[1] - r[0], -r[0], -r[2]), default=None)
    shown = (None,) * 4 if best is None else (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
    lines = "".join(f"{a},{b - a},{q}\n" for a, b, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    return doc_id, len(runs), *shown, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def test_documents(odd, docs, none):
    short = docs.filter("length(text) < 6000")
    for df in (odd.filter("doc_id IS NULL OR doc_id NOT IN (8, 9)"), short):
        wanted = Counter(digest(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())
        assert Counter(tuple(r)[:8] for r in periodic_runs.digest_documents(df).collect()) == wanted
    assert periodic_runs.digest_documents(none).count() == 0
    assert periodic_runs.digest_documents(odd).count() == odd.count()


def test_a_text_loses_its_repeats(spark):
    df = spark.createDataFrame([(1, "say no no no no no no more"), (2, None), (1, "say no no no no no no more")], "doc_id long, text string")
    rows = periodic_runs.find(df).orderBy("doc_id").collect()
    assert [r["text"] for r in rows] == ["say no more", "say no more", ""]
    assert [[tuple(x) for x in r["runs"]] for r in rows] == [[(1, 6, 1)]] * 2 + [[]]


def test_very_long_texts(spark):
    df = spark.createDataFrame([(1, "la " * 200_000), (2, " ".join(f"w{i % 30_011}" for i in range(130_000)))], "doc_id long, text string")
    found = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in periodic_runs.find(df).select("doc_id", "runs").collect()}
    assert found == {1: [(0, 200_000, 1)], 2: [(0, 130_000, 30_011)]}
