"""Matches of a pattern with their places, from DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches that are folded at a time.
RUN = 64
EMPTY = "array<struct<start:bigint,end:bigint>>"


def none() -> Column:
    return F.array().cast(EMPTY)


def pieces(text: Column, pattern: str) -> tuple[Column, Column]:
    """The matches, leftmost and without overlap, and the one more gaps around them."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def placed(matches: Column, gaps: Column, valid: Column | None = None) -> Column:
    """Spans (start, end) in code points; valid: which matches to keep.

    Sums run over the lengths alone; texts are not touched again. Matches are
    folded in runs of RUN, and the runs then, so that no list of all spans is
    copied for each.
    """
    lengths = F.transform(matches, lambda m: F.length(m).cast("bigint"))
    before = F.transform(gaps, lambda g: F.length(g).cast("bigint"))
    step = F.arrays_zip(lengths.alias("m"), F.slice(before, 1, F.greatest(F.size(matches), F.lit(1))).alias("g"), (valid if valid is not None else F.transform(matches, lambda m: F.lit(True))).alias("v"))
    zero = F.lit(0).cast("bigint").alias("at")

    def fold(acc: Column, x: Column) -> Column:
        a = acc["at"] + x["g"]
        span = F.array(F.struct(a.alias("start"), (a + x["m"]).alias("end")))
        return F.struct((a + x["m"]).alias("at"), F.when(x["v"], F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def after(acc: Column, run: Column) -> Column:
        moved = F.transform(run["out"], lambda s: F.struct((acc["at"] + s["start"]).alias("start"), (acc["at"] + s["end"]).alias("end")))
        return F.struct((acc["at"] + run["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    def spans(steps: Column) -> Column:
        run = lambda i: F.slice(steps, i * RUN + 1, F.lit(RUN))
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / RUN).cast("int")), lambda i: F.aggregate(run(i), F.struct(zero, none().alias("out")), fold))
        return F.aggregate(runs, F.struct(zero, F.array().cast(f"array<{EMPTY}>").alias("out")), after, lambda acc: F.flatten(acc["out"]))

    return F.when(F.size(matches) > 0, let(step, spans)).otherwise(none())


def near(span: Column, others: Column, scope: int) -> Column:
    """Whether one of the others ends, or starts, at most scope from the span; -1: overlaps it.

    The others are sorted and lie apart: of those that start early enough the
    last one, found by halving, ends last.
    """
    bits = F.sequence(F.lit(1), F.length(F.bin(F.size(others))))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"] + 1) / 2).cast("int")
        early = F.get(others, middle - 1)["start"] <= span["end"] + scope
        on = acc["low"] < acc["high"]
        return F.struct(F.when(on & early, middle).otherwise(acc["low"]).alias("low"), F.when(on & ~early, middle - 1).otherwise(acc["high"]).alias("high"))

    last = F.aggregate(bits, F.struct(F.lit(0).alias("low"), F.size(others).alias("high")), halve, lambda acc: acc["low"])
    return F.coalesce(F.get(others, last - 1)["end"] >= span["start"] - scope, F.lit(False))


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
