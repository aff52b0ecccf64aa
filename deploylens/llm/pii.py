"""Personal data by weak supervision, in DataFrame functions only.

Base patterns find e-mail addresses, IP addresses, card and phone numbers. Beside them come candidates that the
base leaves: disguised e-mail addresses, phone numbers without a country code, identity numbers, and base
shapes that failed a check. Labelers (shape, check, gazetteer, words around, words that speak against) vote on every candidate or
abstain. Expectation-maximisation over the counts of vote patterns by kind, a table of bounded size, estimates
how reliable each labeler is; its posteriors then train the final classifier, a log-linear model of
kind and votes, that decides on the candidates. Base spans always stay.

Very long texts are scanned whole. Null texts count as empty. Offsets are code points, ends exclusive. Repeated rows get a row each; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, spans

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "id")
LABELERS = ("shape", "check", "gazetteer", "context", "against")
ABSTAIN, YES, NO = 0, 1, 2
ROUNDS = 60
#: Values of ``features``.
FEATURES = 6 * 2**5

#: Last labels of host names. Fixed values.
LAST_LABELS = "com|org|net|edu|gov|mil|int|info|biz|io|dev|app|co|uk|de|fr|es|it|nl|be|ch|at|eu|us|ca|mx|br|ar|cl|jp|cn|kr|in|au|nz|za|ru|ua|pl|cz|se|no|fi|dk|pt|ie|gr|tr|il|example|test|local"
#: Words that go before a kind of personal data. Fixed values.
CONTEXT = {
    "email": "e-?mail|mail|contact|write to|correo|courriel|kontakt",
    "ip": r"\bip\b|address|host|server|client|adresse|dirección",
    "card": "card|visa|master|amex|credit|debit|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|cell|fax|whatsapp|teléfono|téléphone|telefon|handy",
    "id": "ssn|social security|tax|passport|national id|ausweis|identité|dni",
}
#: Words before a number that is no personal data. Fixed values.
AGAINST = r"version|\bv\.?|release|order|invoice|isbn|issn|doi|chapter|section|figure|table|page|serial|part no|build|rfc"
#: Code points read before a candidate for its context.
BEFORE = 40

_LOCAL = r"A-Za-z0-9._%+\x01-"
_EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"
_IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_CARD = r"[0-9][0-9\x20-]++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_DISGUISED = r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|\{at\}|\x20at\x20)\x20?[A-Za-z0-9-]++\x20?(?:\(dot\)|\[dot\]|\{dot\}|\x20dot\x20)\x20?[A-Za-z0-9-]{2,}+"
_LOCAL_PHONE = r"(?<![0-9+.,-])(?<![0-9]\x20)(?:\([0-9]{2,4}\)\x20?|[0-9]{3,4}[-.\x20])[0-9]{3,4}[-.\x20][0-9]{3,4}(?![0-9-]|[.\x20][0-9])"
_ID = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    back = F.reverse(d)
    value = lambda i: F.substring(back, i, F.lit(1)).cast("int")
    term = lambda i: F.when(i % 2 == 1, value(i)).otherwise((value(i) * 2) % 10 + F.floor(value(i) / 5).cast("int"))
    places = F.sequence(F.lit(1), F.length(d))
    return F.when(F.length(d) > 0, F.aggregate(places, F.lit(0), lambda acc, i: acc + term(i)) % 10 == 0).otherwise(False)


def valid(x: Column) -> Column:
    """The check of a base match."""
    d = digits(x["m"])
    return (
        F.when(x["kind"] == "ip", x["m"].rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"))
        .when(x["kind"] == "card", F.length(d).between(13, 19) & luhn(d))
        .when(x["kind"] == "phone", F.length(d).between(9, 15))
        .otherwise(F.lit(True))
    )


def shapes(text: Column) -> Column:
    """All matches of the base patterns, before their checks. In the text that e-mail addresses are sought in, a dot
    that no label follows is a control character; in that for cards, a separator not between two digits."""
    dots = F.regexp_replace(F.translate(text, "\x01", "\x02"), r"\.(?![A-Za-z0-9-])", "\x01")
    cards = F.regexp_replace(text, r"(?<![0-9])[\x20-]|[\x20-](?![0-9])", "\x01")
    return F.concat(
        spans.around(dots, _EMAIL, "email", F.contains(text, F.lit("@")), BEFORE, "."),
        spans.around(text, _IP, "ip", text.rlike(r"[0-9]\.[0-9]"), BEFORE),
        spans.around(cards, _CARD, "card", text.rlike(r"[0-9][\x20-]?[0-9]"), BEFORE, " "),
        spans.around(text, _PHONE, "phone", text.rlike(r"\+[0-9]"), BEFORE),
    )


def others(text: Column) -> Column:
    """Candidates that are no base shape."""
    return F.concat(
        spans.around(text, _DISGUISED, "email", text.rlike(r"(?i)[\[({\x20]dot[\])}\x20]"), BEFORE),
        spans.around(text, _LOCAL_PHONE, "phone", text.rlike(r"[0-9][-.\x20][0-9]{3}"), BEFORE),
        spans.around(text, _ID, "id", text.rlike(r"[0-9]-[0-9]{2}-[0-9]"), BEFORE),
    )


def votes(x: Column) -> Column:
    """The labelers' votes on a candidate, as a number in base 3."""
    before = F.lower(x["before"])
    d = digits(x["m"])
    context = F.lit(False)
    for kind, words in CONTEXT.items():
        context = F.when(x["kind"] == kind, before.rlike(words)).otherwise(context)
    shape = F.when(x["kind"] == "email", F.when(F.contains(x["m"], F.lit("@")), YES).otherwise(ABSTAIN)).when(x["kind"] == "card", F.when(F.length(d).between(13, 19), YES).otherwise(NO)).when(x["kind"] == "phone", F.when(F.length(d).between(9, 15), YES).otherwise(NO)).otherwise(ABSTAIN)
    check = F.when(x["kind"].isin("ip", "card"), F.when(valid(x), YES).otherwise(NO)).when(x["kind"] == "id", F.when(d.rlike("^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$"), YES).otherwise(NO)).otherwise(ABSTAIN)
    gazetteer = F.when(x["kind"] == "email", F.when(F.lower(x["m"]).rlike(rf"(?:{LAST_LABELS})$"), YES).otherwise(NO)).when(x["kind"] == "ip", F.when(x["m"].rlike(r"^0|\.0[0-9]"), NO).otherwise(ABSTAIN)).when(x["kind"] == "card", F.when(d.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"), YES).otherwise(ABSTAIN)).otherwise(ABSTAIN)
    said = [shape, check, gazetteer, F.when(context, YES).otherwise(ABSTAIN), F.when(before.rlike(rf"(?:{AGAINST})(?:\x20?(?:no|nr|num|number|id)\b)?[^a-z]{{0,6}}$"), NO).otherwise(ABSTAIN)]
    total = F.lit(0)
    for k, v in enumerate(said):
        total = total + v * (3**k)
    return total.cast("int")


def candidates(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, base (spans that pass), more (candidates clear of them, with votes), seen (votes on the base)."""
    voted = lambda a: F.transform(a, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), votes(x).alias("votes"), features(x, x["after"]).alias("looks")))
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("shapes", shapes(F.col("text")))
    found = found.withColumn("base", F.filter("shapes", valid)).withColumn("failed", F.filter("shapes", lambda x: ~valid(x) & x["kind"].isin("ip", "card")))
    found = found.withColumn("more", spans.clear_of(F.concat(F.filter("failed", lambda x: F.length(digits(x["m"])) >= 7), others(F.col("text"))), F.col("base")))
    return found.select("doc_id", voted(F.col("base")).alias("base"), voted(F.col("more")).alias("more"))


def features(x: Column, after: Column) -> Column:
    """What a candidate looks like and what stands next to it, as a number below ``FEATURES``: how many digits it has (in six steps), whether its digits stand in three groups
    and more, whether few of them differ, whether a letter, a digit or a dash is its left or right neighbour, and whether a word leads to it."""
    d = digits(x["m"])
    n = F.length(d)
    step = F.when(n == 0, 0).when(n < 8, 1).when(n < 11, 2).when(n < 13, 3).when(n < 20, 4).otherwise(5)
    groups = F.size(F.regexp_extract_all(x["m"], F.lit("[0-9]+"), F.lit(0)))
    alike = (n > 3) & (F.size(F.array_distinct(F.split(d, ""))) <= 3)
    flags = (groups >= 3, alike, x["before"].rlike(r"[\p{L}0-9_-]\z"), after.rlike(r"^[\p{L}0-9_-]"), x["before"].rlike(r"\p{L}[^\p{L}0-9]{1,3}\z"))
    return (step + 6 * sum(F.coalesce(f, F.lit(False)).cast("int") * 2**k for k, f in enumerate(flags))).cast("int")


def unpack(v: np.ndarray) -> np.ndarray:
    return v[:, None] // 3 ** np.arange(len(LABELERS)) % 3


#: Votes that each labeler is imagined to have cast on true and on false candidates, by abstaining, yes and no.
IMAGINED = np.array([[3.0, 6.0, 1.0], [3.0, 2.0, 5.0]])
#: What a labeler's vote weighs in the first guess, from which the estimation starts: a check sum outweighs the others.
FIRST = np.array([1.5, 4.5, 1.5, 1.5, 1.5])


def reliabilities(patterns: np.ndarray, kinds: np.ndarray, counts: np.ndarray, base: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Posterior of each (kind, votes) by expectation-maximisation of one prior a kind and, for each labeler and kind, how often it says yes, says no and abstains on
    true and on false candidates. A labeler that only ever says one thing tells by its silence too, and one that says the same of a whole kind tells nothing. Spans of the base stay whatever is said, so they count as true throughout. Estimates are the likeliest with a few imagined votes, and are not bounded else."""
    said = (patterns[:, :, None] == np.arange(3)).astype(float)
    post = 1 / (1 + np.exp(-((patterns == YES) * 1.0 - (patterns == NO)) @ FIRST))
    for _ in range(rounds):
        post = np.where(base, 1.0, post)
        weights = np.stack([counts * post, counts * (1 - post)])
        rates = np.stack([np.einsum("cn,njv->cjv", weights[:, kinds == k], said[kinds == k]) for k in range(len(KINDS))], 1) + IMAGINED[:, None, None, :]
        rates /= rates.sum(3, keepdims=True)
        prior = np.array([(weights[0][kinds == j].sum() + 1) / (counts[kinds == j].sum() + 2) for j in range(len(KINDS))])
        chance = np.einsum("njv,cnjv->cn", said, np.log(rates[:, kinds])) + np.log(np.stack([prior[kinds], 1 - prior[kinds]]))
        post = 1 / (1 + np.exp(np.clip(chance[1] - chance[0], -500, 500)))
    return post


def described(kinds: np.ndarray, patterns: np.ndarray, looks: np.ndarray) -> np.ndarray:
    """The classifier's inputs: kind, votes, and the steps and flags of ``features``."""
    flags = looks[:, None] // 6 // 2 ** np.arange(5) % 2
    return np.concatenate([np.eye(len(KINDS))[kinds], patterns == YES, patterns == NO, np.eye(6)[looks % 6], flags], 1).astype(float)


def classifier(x: np.ndarray, counts: np.ndarray, post: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Logistic regression of the posteriors by Newton's steps, with a small penalty; gives the chance of each row of ``x``. A candidate's weight is its number,
    but evenly over the kinds, so that a kind with few candidates is learnt too."""
    each = np.array([counts[x[:, j] > 0].sum() for j in range(len(KINDS))])
    weight = counts / np.maximum(each, 1)[x[:, : len(KINDS)].argmax(1)]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - post)) + 1e-3 * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        move = np.linalg.solve(bend, slope)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    rows = common.written(candidates(common.doc_texts(docs)), "pii")
    tagged = lambda c, base: F.transform(c, lambda x: F.struct(x["kind"].alias("kind"), x["votes"].alias("votes"), x["looks"].alias("looks"), F.lit(base).alias("base")))
    voted = rows.select(F.explode(F.concat(tagged("base", True), tagged("more", False))).alias("x")).groupBy("x.kind", "x.votes", "x.looks", "x.base").agg(F.count("*").alias("n"))
    table = voted.collect()  # twice the kinds times 3**labelers times FEATURES at most, and far fewer that occur
    accepted = F.lit(False)
    if table:
        patterns, kinds, counts = unpack(np.array([r["votes"] for r in table], np.int64)), np.array([KINDS.index(r["kind"]) for r in table]), np.array([r["n"] for r in table], float)
        x = described(kinds, patterns, np.array([r["looks"] for r in table], np.int64))
        chance = classifier(x, counts, reliabilities(patterns, kinds, counts, np.array([r["base"] for r in table])))
        keys = [f"{r['kind']}:{r['votes']}:{r['looks']}" for r, p in zip(table, chance, strict=True) if p >= 0.5 and not r["base"]]
        accepted = lambda x: F.concat_ws(":", x["kind"], x["votes"].cast("string"), x["looks"].cast("string")).isin(keys) if keys else F.lit(False)
        rows = rows.withColumn("more", F.filter("more", accepted))
    base, every = spans.ordered(F.col("base"), KINDS, False), spans.ordered(F.concat("base", "more"), KINDS, False)
    counts = [spans.of_kind(F.col("base"), k).alias(f"n_{k}") for k in BASE]
    return rows.select("doc_id", *counts, F.sha2(spans.joined(base), 256).alias("base_sha256"), spans.joined(every).alias("spans"))
