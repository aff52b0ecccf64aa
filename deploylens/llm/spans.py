"""Spans of regular-expression matches as Spark columns: start and end in code points, without Python.

A text is cut by the pattern; the lengths of the gaps and of the matches give every position. They are added up in chunks
and the chunks' totals after that, so that a text with very many matches takes no time with their square.
Patterns must be free of group repetition, whose recursion depth would grow with the text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches whose positions are added up at once.
CHUNK = 256
SPAN = "array<struct<kind:string,s:int,e:int,m:string>>"


def none() -> Column:
    return F.array().cast(SPAN)


def spans(text: Column, pattern: str, kind: str, gate: Column) -> Column:
    """Leftmost non-overlapping matches as (kind, s, e, m), where ``gate`` holds; else none."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), none().alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["gap"])
        e = s + F.length(x["m"])
        one = F.struct(F.lit(kind).alias("kind"), s.alias("s"), e.alias("e"), x["m"].alias("m"))
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def moved(found: Column, by: Column) -> Column:
        return F.transform(found, lambda x: F.struct(x["kind"].alias("kind"), (x["s"] + by).alias("s"), (x["e"] + by).alias("e"), x["m"].alias("m")))

    def placed(pairs: Column) -> Column:
        last = F.floor(F.greatest(F.size(pairs) - 1, F.lit(0)) / CHUNK).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), last), lambda c: F.aggregate(F.slice(pairs, c * CHUNK + 1, F.lit(CHUNK)), start, step))
        whole = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
        return F.flatten(F.aggregate(chunks, whole, lambda acc, c: F.struct((acc["at"] + c["at"]).alias("at"), F.concat(acc["out"], F.array(moved(c["out"], acc["at"]))).alias("out")))["out"])

    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("m")))
    made = F.flatten(F.transform(F.array(pairs), placed))  # through an array of one, so that the pattern runs once
    return F.when(gate, made).otherwise(none())


NEAR = "array<struct<kind:string,s:int,e:int,m:string,before:string,after:string>>"


def around(text: Column, pattern: str, kind: str, gate: Column, most: int, stand_in: str | None = None) -> Column:
    """The same with ``most`` code points before each match and the one after it, from the pieces that the text was cut into. ``stand_in``
    is what a control character of the text takes the place of."""
    plain = lambda c: c if stand_in is None else F.translate(c, "\x01", stand_in)

    def ends(parts: Column) -> Column:
        found, gaps = parts["found"], parts["gaps"]
        whole = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, x: F.concat(F.right(g, F.lit(most)), F.right(x["m"], F.lit(most))))
        return F.struct(found.alias("found"), gaps.alias("gaps"), whole.alias("whole"))

    def dressed(parts: Column) -> Column:
        found, gaps, whole = parts["found"], parts["gaps"], parts["whole"]
        # a match has a character at least: so many of them before it reach as far as asked
        lead = lambda i: F.array_join(F.slice(whole, F.greatest(i + 1 - most, F.lit(1)), F.least(i, F.lit(most))), "")

        def one(x: Column, i: Column) -> Column:
            gap = F.right(gaps[i], F.lit(most))
            before = F.when((F.length(gap) >= most) | (i == 0), gap).otherwise(F.right(F.concat(lead(i), gap), F.lit(most)))
            follows = F.when(gaps[i + 1] != "", F.left(gaps[i + 1], F.lit(1))).otherwise(F.left(F.coalesce(F.try_element_at(found, i + 2)["m"], F.lit("")), F.lit(1)))
            return F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), plain(before).alias("before"), plain(follows).alias("after"))

        return F.transform(found, one)

    parts = F.struct(spans(text, pattern, kind, gate).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    made = F.flatten(F.transform(F.transform(F.array(parts), ends), dressed))  # through arrays of one, so that each step is made once
    return F.when(gate, made).otherwise(F.array().cast(NEAR))


def clear_of(found: Column, taken: Column) -> Column:
    """The spans of ``found`` that overlap none of ``taken``, which is looked through in chunks: only those that reach a span are
    compared with it one by one. Each kind in ``taken`` is in order, so a chunk covers a short part of the text."""

    def chunk(c: Column) -> Column:
        part = F.slice(taken, c * CHUNK + 1, F.lit(CHUNK))
        return F.struct(F.array_min(F.transform(part, lambda b: b["s"])).alias("s"), F.array_max(F.transform(part, lambda b: b["e"])).alias("e"), part.alias("spans"))

    meet = lambda a, b: (a["s"] < b["e"]) & (b["s"] < a["e"])
    last = F.floor((F.size(taken) - 1) / CHUNK).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), last), chunk)
    free = lambda p: F.filter(found, lambda a: ~F.exists(p, lambda c: meet(a, c) & F.exists(c["spans"], lambda b: meet(a, b))))
    return F.when(F.size(taken) == 0, found).otherwise(F.flatten(F.transform(F.array(chunks), free)))  # through an array of one, so that chunks are made once


def joined(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def ordered(found: Column, kinds: tuple[str, ...], by_start: bool) -> Column:
    """By start and then kind as listed, or the other way round."""
    place = lambda x: F.array_position(F.array(*map(F.lit, kinds)), x["kind"]).cast("int")
    key = lambda x: (x["s"], place(x)) if by_start else (place(x), x["s"])
    tagged = F.transform(found, lambda x: F.struct(key(x)[0].alias("k1"), key(x)[1].alias("k2"), x["e"].alias("k3"), x.alias("x")))
    return F.transform(F.array_sort(tagged), lambda t: t["x"])


def of_kind(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long")
