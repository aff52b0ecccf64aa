"""Quality rules combined by weak supervision.

Each rule looks at one statistic of a text and votes good, bad, or, between its two bounds, abstains. No vote decides:
expectation-maximisation over the counts of vote patterns (a bounded table, whatever the corpus) estimates, for each rule, how often it votes
good and bad on good texts and on bad ones, and how common good texts are. The start, and a prior that weighs as much as a few texts,
only say which way a rule is meant; a rule that votes alike on both kinds gets no weight, and one that errs often a small one. A text is kept if its
posterior probability of being good is at least one half, unless the base rule fails it. Abstentions say nothing.

Null texts have no words and fail the base rule. Very long texts are counted whole; counts are over whole texts. Repeated rows get a
row each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

GOOD, BAD, ABSTAIN = 1, 2, 0
ROUNDS = 200
#: Votes (good, bad) of a rule that the estimate starts from, on good texts and on bad ones; as a prior they count as so many texts.
START_GOOD, START_BAD, PRIOR_TEXTS = (0.9, 0.1), (0.4, 0.6), 4.0

_word = regex.compile(r"[^\x20\x09-\x0D]").search
_words = regex.compile(r"[^\x20\x09-\x0D]+").findall
_symbols = regex.compile(r"[#*$%&|<>]").findall
_letters = regex.compile(r"\p{L}").findall
_upper = regex.compile(r"\p{Lu}").findall
_ends = regex.compile(r"[.!?…。](?=[\x20\x09-\x0D]|\Z)").findall
_shout = regex.compile(r"[!?]{2,}").findall

#: name, votes bad above this, votes good up to this.
RULES = (
    ("symbols", 0.10, 0.01),
    ("repeats", 0.20, 0.02),
    ("repeated lines", 0.30, 0.05),
    ("capitals", 0.40, 0.10),
    ("shouting", 0.20, 0.02),
    ("few letters", 0.20, 0.06),
    ("one word", 0.20, 0.10),
    ("word length", 1.0, 0.5),
    ("sentences", 0.8, 0.05),
)


def statistics(text: str) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, then the rules' statistics in order."""
    words = _words(text)
    n, chars = len(words), sum(map(len, words))
    seen, dup, full = set(), 0, 0
    for line in text.split("\n"):
        if _word(line):
            full += 1
            dup += line in seen
            seen.add(line)
    symbols = len(_symbols(text))
    repeat, top = 0, 0
    if n:
        ids: dict[str, int] = {}
        code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        top = int(np.bincount(code).max())
        if n >= 3:
            first = code[:-2] * len(ids) + code[1:-1]
            _, first = np.unique(first, return_inverse=True)
            _, which, count = np.unique(first * len(ids) + code[2:], return_inverse=True, return_counts=True)
            hit = count[which] > 1
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : n - 2 + k] |= hit
            repeat = int(covered.sum())
    letters = len(_letters(text))
    rates = (
        symbols / max(1, n), repeat / max(1, n), dup / max(1, full), len(_upper(text)) / max(1, letters),
        len(_shout(text)) / max(1, n), 1 - letters / max(1, chars), top / max(1, n) if n >= 20 else 0.0, abs(chars / max(1, n) - 5.5) / 2,
        0.0 if 3 * len(_ends(text)) <= n <= 60 * len(_ends(text)) else 1.0,
    )
    return n, chars, symbols, dup, repeat, rates


def vote(rates: tuple) -> int:
    """The rules' votes as a number in base 3."""
    return sum(3**k * (BAD if r > bad else GOOD if r <= good else ABSTAIN) for k, (r, (_, bad, good)) in enumerate(zip(rates, RULES, strict=True)))


def measured(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the base statistics and the vote pattern."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [statistics(t) for t in common.texts(batch)]
        cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols, pa.array([vote(r[5]) for r in rows], pa.int32())], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "votes"])

    return common.map_batches(common.doc_texts(docs), fn, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, votes int")


@dataclass
class VoteModel:
    prior: float
    #: By vote (good, bad) and rule: how often it is cast on good texts, and on bad ones.
    on_good: np.ndarray
    on_bad: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability that texts with these votes are good; abstentions say nothing."""
        cast = np.stack([patterns == GOOD, patterns == BAD], 1).astype(float)
        weight = np.log(self.on_good) - np.log(self.on_bad)
        odds = np.log(self.prior) - np.log1p(-self.prior) + (cast * weight).sum((1, 2))
        return 1 / (1 + np.exp(np.clip(-odds, -500, 500)))


def unpack(votes: np.ndarray) -> np.ndarray:
    return votes[:, None] // 3 ** np.arange(len(RULES)) % 3


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> VoteModel:
    """Expectation-maximisation over vote patterns and how many texts have each."""
    cast = np.stack([patterns == GOOD, patterns == BAD], 1).astype(float)
    start = [np.array(x)[:, None] * np.ones(patterns.shape[1]) for x in (START_GOOD, START_BAD)]
    model = VoteModel(0.7, *start)
    for _ in range(rounds):
        good = counts * model.posterior(patterns)
        votes = [np.tensordot(w, cast, 1) + PRIOR_TEXTS * s for w, s in zip((good, counts - good), start, strict=True)]
        model = VoteModel(float((good.sum() + 2) / (counts.sum() + 4)), *(v / v.sum(0) for v in votes))
    return model


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept, p_good."""
    rows = common.written(measured(docs), "quality")
    counted = rows.groupBy("votes").agg(F.count("*").alias("n")).collect()  # 3**rules patterns at most
    patterns = unpack(np.array([r["votes"] for r in counted], np.int64))
    model = estimate(patterns, np.array([r["n"] for r in counted], float))
    table = [(int(r["votes"]), float(p)) for r, p in zip(counted, model.posterior(patterns), strict=True)]
    verdict = docs.sparkSession.createDataFrame(table, "votes int, p_good double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.join(F.broadcast(verdict), "votes").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("p_good") >= 0.5)).alias("kept"), "p_good",
    )
