import random
import re
import zlib
from collections import Counter

import pytest

from deploylens.llm import common, spelling


def vocabulary(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 97 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            found[low] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def one_edit(x, y):
    if len(x) > len(y):
        x, y = y, x
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    return len(y) - len(x) == 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def by_hand(words):
    near = {x: [y for y in words if abs(len(x) - len(y)) < 2 and one_edit(x, y)] for x in words}
    form = {}
    for x, ys in near.items():
        best = min(ys, key=lambda y: (-words[y], y), default=None)
        form[x] = best if best is not None and words[best] >= 2 * words[x] else None
    out = set()
    for x, n in words.items():
        root = x
        while form[root] is not None:
            root = form[root]
        out.add((x, form[x], root, n, len(near[x]), words.get(form[x])))
    return out


def drawn(seed, letters, many, longest):
    rng = random.Random(seed)
    words = {}
    for _ in range(many):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(5, longest)))
        for _ in range(3):
            words[w] = rng.randint(3, 100)
            i = rng.randrange(len(w))
            v = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]])
            if len(v) >= 5:
                words[v] = rng.randint(3, 100)
                w = v
    return words


@pytest.mark.parametrize("group", [20_000, 4])
def test_variants_equal_those_found_by_hand(spark, group):
    """Also where nearly all groups are dealt anew."""
    words = {}
    for k, (letters, longest) in enumerate((("ab", 8), ("abé", 7), ("abcdefgh", 11))):
        words |= drawn(k, letters, 60, longest)
    words |= {"a" * k: 3 + k for k in range(5, 14)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert {tuple(r) for r in spelling.variants(df, group=group).collect()} == by_hand(words)


def test_documents(spark, odd, docs, none):
    few = docs.filter("length(text) < 5000")
    for df in (odd, few):
        wanted = by_hand(vocabulary([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]))
        rows = spelling.group_variants(df).collect()
        assert len(rows) == len(wanted) and {tuple(r) for r in rows} == wanted
    assert spelling.group_variants(none).count() == 0


def test_letters_and_ties(spark):
    """Only A-Z are lower-cased; of equally frequent forms the smallest in code-point order counts; a chain is followed to its end."""
    text = " ".join(["ÉTUDES"] * 3 + ["Études"] * 6 + ["word×s"] * 3 + ["housee"] * 3 + ["house"] * 6 + ["housed"] * 6 + ["mouse"] * 12 + ["日house1mouse"] * 1)
    found = {r["word"]: r for r in spelling.group_variants(spark.createDataFrame([(7, text)], "doc_id int, text string")).collect()}
    assert set(found) == {"Études", "word×s", "housee", "house", "housed", "mouse"} and found["Études"]["n"] == 9
    assert (found["housee"]["form"], found["housee"]["root"], found["housee"]["form_n"]) == ("house", "house", 7)
    assert (found["house"]["form"], found["house"]["root"], found["house"]["n_near"]) == (None, "house", 3)


def test_a_crowded_stem_is_dealt_anew(spark):
    """A stem that most words share: no group is larger than asked, but those of one-letter rests."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [("stemstem" + x + y + z, 3) for x in letters[:12] for y in letters for z in letters[:5]]
    df = spark.createDataFrame(words, "word string, n long")
    scratch = common.Scratch(spark)
    found = spelling.near_words(df, scratch, group=200)
    assert {(r["word"], r["n_near"]) for r in found.collect()} == {(w, 11 + 25 + 4) for w, _ in words}
