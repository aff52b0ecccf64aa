import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from deploylens.llm import language_id, quality, topk, toxicity
from deploylens.llm import queries as Q

SF = "/root/testdata/sf0.01"


def brute_topk(rows, k=20):
    ok = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    asked = {}
    for i, x in ok:
        if i % 20 == 0:
            asked[i] = min(asked.get(i, tuple(x)), tuple(x))
    out = Counter()
    for q, x in asked.items():
        scored = sorted((-int(np.dot(x, y)), i) for i, y in ok if i != q and len(y) == len(x))[:k]
        out.update((q, n, i, -s) for n, (s, i) in enumerate(scored, 1))
    return out


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=16) * (1 + i % 3)]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None] * 8), (302, [float("nan")] * 16), (303, [float("inf")] * 16), (None, [0.5] * 16), (320, [0.1, 0.2]), (321, [0.3, 0.4]), (7, rows[7][1]), (20, rows[20][1]), (340, []), (400, [1e6] * 16), (401, [-1e6] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert Counter(map(tuple, topk.search(df).collect())) == brute_topk(rows)
    assert topk.search(df.filter("vec_id = -1")).count() == 0


def test_scores_beyond_64_bits_are_the_largest_number(spark):
    """Finite components of any size take part; what goes beyond 64 bits ranks as the largest number of its sign."""
    rows = [(0, [1e300, 1.0]), (1, [1e300, 1.0]), (2, [-1e300, 0.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, [1e17, 1.0]), (20, [1e18, -1e18])]
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    top = 2**63 - 1
    assert [found[0, k] for k in range(1, 7)] == [(1, top), (3, top), (5, top), (20, top), (4, 0), (2, -top)]
    big = [(i, [float(10 ** (i % 19)) * (-1) ** i, 1.0]) for i in range(60)]
    a = topk.search(spark.createDataFrame(big, "vec_id long, embedding array<double>")).collect()
    assert len(a) == 60 and all(abs(r["score"]) <= top for r in a)


def test_search_equals_brute_force_on_a_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert Counter(map(tuple, topk.search(df).collect())) == brute_topk([(r["vec_id"], r["embedding"]) for r in df.collect()])


def test_languages_are_told_apart(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = Q.op7_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    got = {r["doc_id"]: r for r in language_id.identify(odd).collect()}
    assert got[0]["lang_pred"] == got[2]["lang_pred"] == "und" and got[0]["score"] == 0 and got[8]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id.identify(none).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.identify(unlabelled).collect()} == {"und"}


def test_clean_documents_are_accepted(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = language_id.accepted(docs, language_id.train(docs))
    assert kept.columns == docs.columns and kept.count() >= 0.995 * docs.count()


def test_unlearnt_languages_and_noise_are_rejected_at_every_length(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("lang IS NOT NULL AND text IS NOT NULL")
    model, rng = language_id.train(docs), random.Random(8)
    out = lambda text: model.score(language_id.ngrams(text))[2]
    russian = "все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью".split()
    noise = lambda: "".join(rng.choice("qxzjkvwybcdfghmp") for _ in range(rng.randint(3, 9)))
    for n in (20, 2000, 20_000, 60_000, 200_000):
        assert all(out(" ".join(rng.choice(russian) for _ in range(n // 8 + 1)).encode()[:n]) for _ in range(10))
        if n > 20:  # three made-up words may hold some n-grams of a language
            assert all(out(" ".join(noise() for _ in range(n // 5)).encode()[:n]) for _ in range(10))
    texts = [r["text"].encode() for r in docs.collect()]
    for n in (6, 12, 20, 40):
        whole = [t[:n] for t in texts if len(t) > n and re.search(rb"[A-Za-z]", t[:n])]
        assert np.mean([out(t) for t in whole]) < 0.02


def test_toxic_documents_score_higher(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.rate(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    right = [(r["predicted"], r["toxic"]) for r in rows]
    hit = sum(p and t for p, t in right)
    assert hit / sum(t for _, t in right) > 0.8 and hit / max(1, sum(p for p, _ in right)) > 0.85


def test_toxicity_scores_mean_the_same_at_every_size(spark):
    rng = random.Random(3)
    words = "some plain words that a text of any kind may hold now and then".split()
    rows = []
    for k in range(6000):  # two in five shout; a quarter of those are toxic
        shouts = k % 5 < 2
        rows.append((k, " ".join(rng.choices(words, k=30)) + (" no! never! not!" if shouts else "."), int(shouts and rng.random() < 0.25)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    share = np.mean([t for _, _, t in rows])
    for sample in (16_000, 1700):  # all labels; a third of the sample toxic
        model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"), sample)
        found = model.scores([t for _, t, _ in rows])
        assert abs(found.mean() - share) < 0.04 and (found >= 0.5).mean() < 0.05


@pytest.mark.parametrize("kinds", [[], [0], [1], [0, 1]])
def test_toxicity_with_few_labels(spark, odd, none, kinds):
    labels = spark.createDataFrame([(k, t) for t in kinds for k in range(3, 9)], "doc_id long, toxic int")
    rows = toxicity.rate(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert toxicity.rate(none, labels).count() == 0


def test_isotonic_fit_rises():
    x, y = toxicity.isotonic(np.array([1, 2, 3, 4, 5.0]), np.array([0, 1, 0, 1, 1.0]))
    assert (np.diff(y) >= 0).all() and y[0] == 0 and y[-1] == 1 and np.interp(2.5, x, y) == 0.5


def base_quality(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    triples = Counter(zip(w, w[1:], w[2:], strict=False))
    inside = {k + j for k in range(len(w) - 2) for j in range(3) if triples[w[k], w[k + 1], w[k + 2]] > 1}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside)


def test_quality_base_and_verdict(spark, odd, docs, none):
    for df in (odd, docs):
        found = quality.judge(df).collect()
        wanted = Counter((r["doc_id"], *base_quality(r["text"] or "")) for r in df.select("doc_id", "text").collect())
        assert Counter(tuple(r)[:6] for r in found) == wanted
        for r in found:
            assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
            assert not (r["base_failed"] and r["kept"])
    assert quality.judge(none).count() == 0


def test_quality_agrees_with_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = [r for r in quality.judge(docs).join(labels, "doc_id").collect() if not r["base_failed"]]
    good, bad = [r for r in rows if r["quality"] == 1], [r for r in rows if r["quality"] == 0]
    assert np.mean([r["kept"] for r in good]) > 0.97
    assert np.mean([not r["kept"] for r in bad]) > 0.9


def test_estimates_follow_the_votes():
    """Votes drawn from known rates: the estimates come near them, and one bad vote of a rule that errs keeps a text, of one that does not drops it."""
    rng = np.random.default_rng(5)
    k, n = len(quality.RULES), 40_000
    good = rng.random(n) < 0.8
    on_good, on_bad = np.array([0.001, 0.3] + [0.02] * (k - 2)), np.array([0.9, 0.5] + [0.6] * (k - 2))
    votes = np.where(rng.random((n, k)) < np.where(good[:, None], on_good, on_bad), quality.BAD, quality.GOOD)
    votes[rng.random((n, k)) < 0.3] = quality.ABSTAIN
    patterns, which, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = quality.estimate(patterns, counts.astype(float))
    assert abs(model.prior - 0.8) < 0.02
    assert np.abs(model.on_good[1] - on_good).max() < 0.02 and np.abs(model.on_bad[1] - on_bad).max() < 0.05
    kept = model.posterior(patterns)[which.ravel()] >= 0.5
    weight = np.log([(1 - on_good) / (1 - on_bad), on_good / on_bad])  # what the true rates would say
    best = np.log(4) + ((votes == quality.GOOD) * weight[0] + (votes == quality.BAD) * weight[1]).sum(1) >= 0
    assert np.mean(kept == good) > np.mean(best == good) - 0.002
    one = (votes == quality.BAD).sum(1) == 1
    assert kept[one & (votes[:, 1] == quality.BAD) & (votes[:, 0] != quality.ABSTAIN)].mean() > 0.9
    assert (~kept)[(votes == quality.BAD).sum(1) >= 4].mean() > 0.99


def test_no_single_rule_decides(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = quality.measured(docs).groupBy("votes").count().collect()
    patterns, counts = quality.unpack(np.array([r["votes"] for r in found])), np.array([r["count"] for r in found], float)
    kept = quality.estimate(patterns, counts).posterior(patterns) >= 0.5
    one = (patterns == quality.BAD).sum(1) == 1
    assert counts[one & kept].sum() > 0 and counts[one & ~kept].sum() > 0


def test_pipeline_runs_over_odd_rows(spark, odd, none):
    import corpus_pipeline

    for df in (odd, none):
        made = df
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, made, SF)
            if name != "packing":
                assert made.columns == odd.columns
        assert made.count() >= (df.count() > 0)
