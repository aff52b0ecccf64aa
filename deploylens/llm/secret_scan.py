"""Secrets by pattern and by sliding-window entropy, in DataFrame functions only.

Base patterns find assigned secrets, access keys and long hexadecimal strings. Beside them, every long unbroken string
of key characters is a candidate: a window moves over it, the counts of its characters change by one in and one out, and
the Shannon entropy follows from them. The highest window decides, against a bound for the candidate's
character class. Candidates without a digit or without a letter (words, names, numbers), and those that hold a word of the allow-list, are
suppressed. Base spans stay.

Very long texts are scanned whole. Null texts count as empty. Offsets are code points, ends exclusive. Repeated rows get a row each; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, spans

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "entropy")
WINDOW = 20
#: Bits a character that a window must reach, by class; a window of 20 different characters has 4.32.
BOUNDS = {"hex": 3.0, "lower": 3.9, "upper": 3.9, "alnum": 3.6, "mixed": 3.7}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: What no secret contains, in lower case. Fixed values.
ALLOWED = "example|sample|dummy|placeholder|changeme|lorem|0123456789|abcdefgh|qwerty|xxxxx"

_ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?+\x20*+[:=]\x20*+[\"']?+[A-Za-z0-9+/_.=-]++"
_VALUE = r"^[A-Za-z_]+[\"']?\x20*[:=]\x20*[\"']?(.*)$"
_ACCESS = "AKIA[A-Z0-9]++"
_HEX = "[0-9a-f]{16,}+"
_CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}+"


def base(text: Column) -> Column:
    found = F.concat(
        spans.spans(text, _ASSIGN, "assign", text.rlike("(?i)(?:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]")),
        spans.spans(text, _ACCESS, "access", F.contains(text, F.lit("AKIA"))),
        spans.spans(text, _HEX, "hex", text.rlike("[0-9a-f]{16}")),
    )
    value = lambda x: F.length(F.regexp_extract(x["m"], _VALUE, 1))
    return F.filter(found, lambda x: F.when(x["kind"] == "assign", value(x) >= 12).when(x["kind"] == "access", F.length(x["m"]) >= 18).otherwise(True))


def highest_entropy(s: Column) -> Column:
    """Largest entropy of a window of ``s``. The state holds the count of each character of the alphabet and the sum
    of c * log2 c; a step adds the character that comes in and takes off the one that goes out."""
    weight = lambda c: F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(0.0)
    place = lambda i: F.instr(F.lit(ALPHABET), F.substring(s, i, F.lit(1)))
    start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

    def step(acc: Column, i: Column) -> Column:
        def moved(inn: Column, out: Column) -> Column:
            a, b = F.try_element_at(acc["counts"], inn), F.try_element_at(acc["counts"], F.greatest(out, F.lit(1)))
            same = inn == out
            change = weight(a + 1) - weight(a) + F.when(out > 0, weight(b - 1) - weight(b)).otherwise(0.0)
            total = F.when(same, acc["sum"]).otherwise(acc["sum"] + change)
            counts = F.when(same, acc["counts"]).otherwise(F.transform(acc["counts"], lambda c, k: c + F.when(k + 1 == inn, 1).when(k + 1 == out, -1).otherwise(0)))
            best = F.when(i >= WINDOW, F.greatest(acc["best"], F.lit(math.log2(WINDOW)) - total / WINDOW)).otherwise(acc["best"])
            return F.struct(counts.alias("counts"), total.alias("sum"), best.alias("best"))

        return moved(place(i), F.when(i > WINDOW, place(i - WINDOW)).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(s)), start, step)["best"]


def suspicious(x: Column) -> Column:
    m = x["m"]
    allowed = ~(m.rlike("[0-9]") & m.rlike("[A-Za-z]")) | F.lower(m).rlike(ALLOWED)
    bound = F.when(m.rlike("^[0-9a-f]+$"), BOUNDS["hex"]).when(m.rlike("^[0-9a-z+/_=-]+$"), BOUNDS["lower"]).when(m.rlike("^[0-9A-Z+/_=-]+$"), BOUNDS["upper"]).when(m.rlike("^[0-9A-Za-z]+$"), BOUNDS["alnum"]).otherwise(BOUNDS["mixed"])
    return F.when(allowed, False).otherwise(highest_entropy(m) >= bound)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, text, base and more: the spans of every row."""
    text = F.col("text")
    rows = common.doc_texts(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("base", base(text))
    found = spans.spans(text, _CANDIDATE, "entropy", text.rlike(_CANDIDATE))
    return rows.withColumn("more", F.filter(spans.clear_of(found, F.col("base")), suspicious))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    ordered, every = spans.ordered(F.col("base"), KINDS, True), spans.ordered(F.concat("base", "more"), KINDS, True)
    counts = [spans.of_kind(F.col("base"), k).alias(f"n_{k}") for k in BASE]
    return scan(docs).select("doc_id", *counts, F.sha2(spans.joined(ordered), 256).alias("base_sha256"), spans.joined(every).alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with each secret in text replaced by ``mark``, overlapping spans as one; other columns as they are.
    Rows without one are untouched; n_chars, where there is one, follows the text."""
    text = F.coalesce("text", F.lit(""))
    own, every = common.free_name(docs, "_base"), common.free_name(docs, "_all")
    rows = docs.withColumn(own, base(text))
    found = spans.spans(text, _CANDIDATE, "entropy", text.rlike(_CANDIDATE))
    rows = rows.withColumn(every, spans.ordered(F.concat(own, F.filter(spans.clear_of(found, F.col(own)), suspicious)), KINDS, True))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
        fresh = (x["s"] >= acc["at"]) & ((x["e"] > acc["at"]) | (acc["at"] == 0))
        out = F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), out.alias("out"))

    cut = F.aggregate(every, start, step)
    made = F.when(F.size(every) == 0, F.col("text")).otherwise(F.concat(cut["out"], F.substring(text, cut["at"] + 1, F.length(text))))
    rows = rows.withColumn("text", made)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.size(every) == 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return rows.select(*docs.columns)
