"""Positions of regular-expression matches as column expressions.

Spark has the matches of a pattern and the pieces between them, but no positions; the running sum of
their lengths gives them, in code points. The pieces come from the same leftmost, non-overlapping scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<s:int,e:int,t:string>>"
#: Matches that are summed at once; the sums of these groups are then added up.
GROUP = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: inside a lambda an expression would be computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sums(values: Column, start: Column) -> Column:
    """start and the sum of the array up to and with each element; for short arrays, as appending copies."""

    def step(acc, x):
        return F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"] + x).alias("out"))

    return F.aggregate(values, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])


def running(lengths: Column) -> Column:
    """Sum of the array up to and with each element, in groups of GROUP and then over the groups' sums."""

    def whole(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x))
        before = F.concat(F.array(F.lit(0)), _sums(totals, F.lit(0)))
        return F.flatten(F.zip_with(parts, F.slice(before, 1, F.size(parts)), lambda p, b: _sums(p, b)))

    def groups(v: Column) -> Column:
        cuts = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / GROUP).cast("int"))
        return let(F.transform(cuts, lambda k: F.slice(v, k * GROUP + 1, F.lit(GROUP))), whole)

    return let(lengths, lambda v: F.when(F.size(v) <= GROUP, _sums(v, F.lit(0))).otherwise(groups(v)))


#: The last two words of a text, or its only one, with what blank space follows.
_LAST_TWO = r"(?<!\S)(?:\S++\s++)?\S++\s*+$"


def matches(text: Column, pattern: str, guard: Column | None = None, left: bool = False) -> Column:
    """array<struct<s, e, t>>: start, end (exclusive) and text of each match, in order; with left, also l.

    l: the last two whole words of what lies between the match and the one before it, fewer if there are.
    """

    def placed(x: Column) -> Column:
        m, gaps = x["m"], F.slice(x["gaps"], 1, F.size(x["m"]))
        ends = running(F.zip_with(m, gaps, lambda t, g: F.length(g) + F.length(t)))
        spans = F.zip_with(ends, m, lambda e, t: F.struct((e - F.length(t)).alias("s"), e.alias("e"), t.alias("t")))
        if not left:
            return spans
        return F.zip_with(spans, gaps, lambda x, g: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t"), F.regexp_extract(g, _LAST_TWO, 0).alias("l")))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gaps"))
    test = F.rlike(text, F.lit(pattern)) if guard is None else guard & F.rlike(text, F.lit(pattern))
    return F.when(test, let(both, placed)).otherwise(F.array().cast(SPAN if not left else SPAN.replace("t:string", "t:string,l:string")))


def labelled(spans: Column, kind: str, rank: int) -> Column:
    """The spans as array<struct<s, r, e, kind>>; r orders kinds."""
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("r"), x["e"].alias("e"), F.lit(kind).alias("kind")))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
