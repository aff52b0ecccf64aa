import hashlib
import random
from collections import Counter

import numpy as np
import xxhash

from deploylens.llm import near_dedup, simhash, suffix_dedup


def reference_print(text, words_each=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64(b" ".join(w[i : i + words_each]), seed=42).intdigest() for i in range(max(1, len(w) - words_each + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closed(fps, near=4):
    """Component of each distinct fingerprint by comparing all."""
    fps, top = sorted(set(fps)), {}
    find = lambda x: x if top.setdefault(x, x) == x else find(top[x])
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if bin(a ^ b).count("1") <= near and find(a) != find(b):
                top[find(b)] = find(a)
    return {f: find(f) for f in fps}


def check(df):
    rows = [(r["doc_id"], reference_print(r["text"])) for r in df.select("doc_id", "text").collect()]
    root = closed([f for _, f in rows])
    least = {}
    for d, f in rows:
        if d is not None:
            least[root[f]] = min(d, least.get(root[f], d))
    wanted = Counter((d, f"{f:016x}", least.get(root[f])) for d, f in rows)
    assert Counter(map(tuple, simhash.near_duplicates(df).collect())) == wanted


def test_components_equal_brute_force(odd, docs, none):
    check(odd)
    check(docs)
    assert simhash.near_duplicates(none).count() == 0


def test_links_lose_no_pair(spark):
    rng, fps = random.Random(4), set()
    for _ in range(60):
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            fps.add(f)
            for b in rng.sample(range(64), rng.randint(1, 6)):
                f ^= 1 << b
    signed = [(int(np.uint64(f).view(np.int64)),) for f in fps]
    found = simhash.components(simhash.links(spark.createDataFrame(signed, "fp long"))).collect()
    got = {r["fp"] % 2**64: r["root"] for r in found}
    root = closed(fps)
    for a in fps:
        for b in fps:
            assert (root[a] == root[b]) == (a == b or (a in got and b in got and got[a] == got[b]))


def test_suffix_array_is_sorted():
    rng = random.Random(1)
    for _ in range(400):
        s = [rng.randint(1, rng.choice([1, 2, 5])) for _ in range(rng.randint(1, 80))]
        assert suffix_dedup.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute(texts, width=400):
    seen = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])
        yield len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()


def repeats(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 9)))
    passage = " ".join(word() for _ in range(120))
    rows = []
    for k in range(260):  # more different neighbourhoods of one passage than a block holds
        cut = rng.randint(0, 60)
        rows.append((k, " ".join(word() for _ in range(8)) + " " + passage[cut : cut + rng.randint(395, 600)] + " " + word()))
    base = " ".join(word() for _ in range(400)).split()
    for k in range(300, 330):
        w = list(base)
        w[rng.randrange(len(w))] = word()
        rows.append((k, " ".join(w)))
    rows += [(400, "y" * 400), (401, "y" * 401), (402, "ab" * 900), (403, "x" * 399), (404, "q" * 400), (404, "q" * 400)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_repeats_equal_brute_force(spark, odd, docs, none):
    for df in (odd.filter("doc_id IS NULL OR doc_id NOT IN (8, 9)"), docs, repeats(spark)):
        rows = df.select("doc_id", "text").collect()
        wanted = Counter((r["doc_id"], *b) for r, b in zip(rows, brute([(r["text"] or "").encode() for r in rows]), strict=True))
        assert Counter(tuple(r)[:5] for r in suffix_dedup.digest_documents(df).collect()) == wanted
    assert suffix_dedup.digest_documents(none).count() == 0


def test_repeated_rows_cost_no_more_than_others(spark):
    """Rows that share number and text, or have no number, have their places once, however many they are."""
    text = " ".join(f"{i * i % 9973}" for i in range(700))
    most = {}
    for n in (2, 300):
        df = spark.createDataFrame([(None, text)] * n, "doc_id long, text string")
        _, marks = suffix_dedup.removed(df)
        most[n] = [len(r["runs"]) for r in marks.collect()]
        assert {tuple(r)[1:4] for r in suffix_dedup.digest_documents(df).collect()} == {(len(text), len(text), 1)}
    assert len(most[300]) == 1 and most[2] == most[300]


def test_crowded_anchors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_REGIONS", 3)  # nearly every anchor is crowded and dealt over blocks
    rows = repeats(spark).select("doc_id", "text").collect()
    wanted = Counter((r["doc_id"], *b) for r, b in zip(rows, brute([(r["text"] or "").encode() for r in rows]), strict=True))
    assert Counter(tuple(r)[:5] for r in suffix_dedup.digest_documents(repeats(spark)).collect()) == wanted


def test_stripping_keeps_rows_and_columns(odd, spark):
    made = suffix_dedup.strip_repeats(odd)
    assert made.columns == odd.columns and made.count() == odd.count()
    kept = {r["doc_id"]: r["text"] for r in made.collect()}
    assert kept[4] == "One two three four five six seven." and kept[0] is None and len(kept[9]) < 500


def test_passages_of_over_fifty_words_go(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 8)))
    passages = [" ".join(word() for _ in range(60)) for _ in range(12)]
    rows = [(k, " ".join(word() for _ in range(80)), passages[k % 12] if k < 60 else "", " ".join(word() for _ in range(80))) for k in range(90)]
    made = suffix_dedup.strip_repeats(spark.createDataFrame([(k, f"{a} {p} {b}" if p else f"{a} {b}") for k, a, p, b in rows], "doc_id long, text string"))
    for r, (_, a, p, b) in zip(made.orderBy("doc_id").collect(), rows, strict=True):
        assert p[10:-10] not in r["text"] if p else r["text"] == f"{a} {b}"
        assert a[:-20] in r["text"] and b[20:] in r["text"]


def test_digests_tell_passages_of_over_fifty_words(spark):
    """Passages below 400 bytes stay, by the contract, but the query tells them: which texts hold them, and what is left without them."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 8)))
    passages = [" ".join(word() for _ in range(53)) for _ in range(12)]
    assert all(240 <= len(p) and len(p) + 40 < 400 for p in passages)
    rows = [(k, " ".join(word() for _ in range(80)) + f" {passages[k % 12] if k < 60 else ''} " + " ".join(word() for _ in range(80))) for k in range(90)]
    for r in suffix_dedup.digest_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert (r["n_removed"], r["n_spans"]) == (0, 0)
        assert r["n_passages"] == (r["doc_id"] < 60) and (len(passages[r["doc_id"] % 12]) <= r["n_passage_bytes"] <= 400 if r["doc_id"] < 60 else r["n_passage_bytes"] == 0)


def both_widths(df):
    rows = df.select("doc_id", "text").collect()
    texts = [(r["text"] or "").encode() for r in rows]
    wanted = Counter((r["doc_id"], *a, *b[1:]) for r, a, b in zip(rows, brute(texts), brute(texts, 240), strict=True))
    names = "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes", "n_passages", "passage_kept_sha256"
    assert Counter(map(tuple, suffix_dedup.digest_documents(df).select(*names).collect())) == wanted


def both_kinds(spark):
    """Repeats just below and above both widths, at the ends of texts, with periods, and in clipped copies."""
    rng, rows = random.Random(21), []
    bytes_of = lambda n: "".join(rng.choices("abcd e", k=n))
    for n in (239, 240, 241, 399, 400, 401, 640, 900):
        p = bytes_of(n)
        rows += [p, p[: n - 1] + "Z", bytes_of(rng.randint(0, 300)) + p, p + bytes_of(rng.randint(0, 300)), bytes_of(50) + p + bytes_of(90) + p]
    for period in (1, 2, 7, 32, 33, 210):
        unit = bytes_of(period)
        rows += [(unit * 900)[:n] for n in (238 + period, 240 + period, 398 + period, 400 + period, 901)]
        rows.append(bytes_of(40) + (unit * 900)[:700] + bytes_of(40))
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def test_both_widths_equal_brute_force(spark, odd, docs):
    for df in (odd.filter("doc_id IS NULL OR doc_id NOT IN (8, 9)"), docs, repeats(spark), both_kinds(spark)):
        both_widths(df)


def test_regions_tell_repeats_of_every_width(monkeypatch):
    """Regions, grouped by anchor as the tasks group them, against brute force; also where regions end at chunks."""
    rng = random.Random(8)
    for turn in range(60):
        monkeypatch.setattr(suffix_dedup, "CHUNK", rng.choice([1 << 19, 5, 23]))
        widths, gram = rng.choice([((12,), 4), ((12, 20), 4), ((9, 12, 40), 2)])
        letters = rng.choice(["a", "ab", "abcdefgh"])
        bits = ["".join(rng.choices(letters, k=rng.randint(1, 40))) for _ in range(5)]
        texts = ["".join(rng.choices([*bits, *letters], k=rng.randint(0, 9))).encode() for _ in range(rng.randint(1, 12))]
        groups, marked = {}, {(t, w): set() for t in range(len(texts)) for w in widths}
        for t, text in enumerate(texts):
            if len(text) >= widths[0]:
                for anchor, where, first, last in zip(*suffix_dedup.regions(text, widths[0], gram), strict=True):
                    r = text[first : last + widths[-1] - 1]
                    groups.setdefault(int(anchor), {}).setdefault((r, int(where - first), int(last - first)), []).append((t, int(first)))
        for group in groups.values():
            made = suffix_dedup.repeated([(r, o, len(places), own) for (r, o, own), places in group.items()], widths)
            for places, found in zip(group.values(), made, strict=True):
                for t, first in places:
                    for a, b, w in found:
                        marked[t, w] |= set(range(first + a, first + b))
        for w in widths:
            seen = Counter(x[i : i + w] for x in texts for i in range(len(x) - w + 1))
            for t, x in enumerate(texts):
                assert marked[t, w] == {i for i in range(len(x) - w + 1) if seen[x[i : i + w]] > 1}, (turn, w)


def test_both_widths_of_crowded_anchors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_REGIONS", 3)
    both_widths(repeats(spark))
    both_widths(both_kinds(spark))


def test_near_copies_keep_one(spark, odd, none):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(5000)}" for _ in range(200)] for _ in range(30)]
    rows = []
    for k, words in enumerate(base):
        rows.append((k, " ".join(words)))
        if k % 3 == 0:  # two edits: a similarity of about 0.9
            w = list(words)
            w[50], w[120] = "edit", "other"
            rows.append((1000 + k, " ".join(w)))
        if k % 5 == 0:
            rows += [(2000 + k, " ".join(words)), (k, " ".join(words))]
    rows.append((3000, None))
    kept = [r["doc_id"] for r in near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept) == [*range(30), 3000]
    made = near_dedup.keep_one(odd)
    assert made.columns == odd.columns
    assert sorted(r["doc_id"] for r in made.filter("doc_id IN (4, 5, 8, 9)").collect()) == [4, 8]
    assert near_dedup.keep_one(none).count() == 0


def test_crowded_template_loses_no_pair(spark):
    """One source's template with many different texts, alike but below the similarity, and a few real pairs among them."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**6)}"
    template, rows = [word() for _ in range(170)], []
    for k in range(1500):
        rows.append((k, template + [word() for _ in range(30)]))
    for k in range(40):
        rows.append((5000 + k, rows[7 * k][1][:-20] + [word() for _ in range(20)]))
    sets = {k: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for k, w in rows}
    similar = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert similar(0, 1) < 0.8 and all(similar(7 * k, 5000 + k) >= 0.8 for k in range(40))
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_dedup.keep_one(df).collect()) == list(range(1500))


def components_of(pairs, n):
    top = list(range(n))
    find = lambda x: x if top[x] == x else find(top[x])
    for a, b in pairs:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_crowded_buckets_lose_no_candidate(spark):
    """Prints that crowd around a few centres, some in one view only: what the buckets connect is what all pairs connect."""
    rng = np.random.default_rng(6)
    rows, flip = [], lambda x, k: x ^ sum(1 << int(b) for b in rng.choice(192, k, replace=False))
    wide = lambda: int.from_bytes(rng.bytes(24), "little")
    for _ in range(4):
        centre = wide()
        rows += [flip(centre, int(rng.integers(0, 40))) for _ in range(60)]
        rows += [(wide() >> 32 << 32) | centre & 0xFFFFFFFF for _ in range(120)]  # agree in the first view, and in no other
    rows += [x ^ 1 << 5 for x in rows[::9]]
    views = [[x >> 32 * v & 0xFFFFFFFF for v in range(6)] for x in rows]
    met = lambda a, b: (rows[a] ^ rows[b]).bit_count() <= near_dedup.PRINT_DISTANCE and any((x ^ y).bit_count() <= 4 for x, y in zip(views[a], views[b], strict=True))
    wanted = components_of(((a, b) for a in range(len(rows)) for b in range(a) if met(a, b)), len(rows))
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(k, *(signed(x >> 64 * w & 2**64 - 1) for w in range(3))) for k, x in enumerate(rows)], "node long, p0 long, p1 long, p2 long")
    for limit in (40_000, 30):  # the second deals every bucket over tiles
        found = near_dedup.candidates(df, limit).collect()
        assert components_of(((r["a"], r["b"]) for r in found), len(rows)) == wanted
    assert len(found) <= 200 * len(rows)


def test_agreeing_blocks_cover_every_pair():
    rng = random.Random(3)
    for nodes in (10, 10**7, 10**9, 10**12):
        masks = near_dedup.blocks_of_bits(nodes)
        for _ in range(300):
            apart = sum(1 << b for b in rng.sample(range(32), 4))
            assert any(not apart & m for m in masks)


def test_linking_equals_all_pairs():
    rng = np.random.default_rng(3)
    for n in (2, 3, 40):
        for _ in range(20):
            bases = [rng.integers(0, 2**40, 60, dtype=np.uint64) for _ in range(3)]
            sets = [np.unique(np.concatenate([bases[k % 3][: 60 - e], rng.integers(0, 2**40, e, dtype=np.uint64)])) for k, e in enumerate(rng.integers(0, 14, n))]
            similar = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
            for asked in (np.ones(n, bool), rng.random(n) < 0.5):
                wanted = components_of(((a, b) for a in range(n) for b in range(a) if (asked[a] or asked[b]) and similar(sets[a], sets[b])), n)
                got = near_dedup.linked(sets, asked)
                assert all((got[a] == got[b]) == (wanted[a] == wanted[b]) for a in range(n) for b in range(a)) or n == 2 and not asked.any()


def near_texts(seed, n):
    """Copies of a few texts with edits of all sizes: similarities from 0.5 to 1."""
    rng = random.Random(seed)
    word, rows = lambda: f"w{rng.randrange(10**6)}", []
    bases = [[word() for _ in range(rng.randint(60, 300))] for _ in range(max(2, n // 25))]
    for k in range(n):
        w = list(bases[rng.randrange(len(bases))])
        for _ in range(rng.randint(0, len(w) // 25)):
            w[rng.randrange(len(w))] = word()
        rows.append((k, " ".join(w)))
    return rows


def groups_of(spark, rows):
    from deploylens.llm import common

    df = spark.createDataFrame(rows, "doc_id long, text string")
    nodes, found = near_dedup.groups(df, common.Scratch(spark))
    root = {r["node"]: r["root"] for r in found.collect()}
    return {r["id"]: root.get(r["node"], r["node"]) for r in nodes.collect()}


def recall(rows, got):
    sets = {k: near_dedup.shingles(t.encode()) for k, t in rows if k in got}
    hit = total = 0
    for a in sets:
        for b in sets:
            if a < b and len(np.intersect1d(sets[a], sets[b], assume_unique=True)) >= 0.8 * len(np.union1d(sets[a], sets[b])):
                total, hit = total + 1, hit + (got[a] == got[b])
    return hit / total, total


def test_recall_against_all_pairs(spark, monkeypatch):
    rows = near_texts(7, 500)
    got = groups_of(spark, rows)
    share, total = recall(rows, got)
    assert total > 500 and share >= 0.98
    monkeypatch.setattr(near_dedup, "TILE_NODES", 4)  # every block of more than four texts goes over its central text and tiles
    again = groups_of(spark, rows)
    sets = lambda g: sorted(sorted(k for k in g if g[k] == x) for x in set(g.values()))
    assert sets(again) == sets(got)


def test_recall_on_a_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text IS NOT NULL").select("doc_id", "text").collect()]
    share, total = recall(rows, groups_of(spark, rows))
    assert total >= 1 and share >= 0.9
