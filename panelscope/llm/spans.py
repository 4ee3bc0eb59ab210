"""Places of regular-expression matches, as DataFrame expressions only.

Spark gives matched texts but not where they lie. Splitting the text by the same
expression gives what lies between the matches, and running sums of lengths are
places. Places are code points; ends are exclusive. Running values are formed by
doubling steps, so the work grows as the matches times their logarithm.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,kind_no:int,end:int,kind:string,value:string>"
MATCH = "struct<start:int,end:int,value:string,inner:string,before:string,after:string>"
CONTEXT = 64  # characters before and after a match that are kept


def doubled(
    items: Column, combine: Callable[[Column, Column, Column], Column],
    finish: Callable[[Column], Column] | None = None,
) -> Column:
    """``items`` after steps 1, 2, 4 ... of combining each with those a step before and after (null beyond the ends)."""
    def step(held: Column, k: Column) -> Column:
        width = F.call_function("shiftleft", F.lit(1), k)
        return F.when(F.size(held) > width, F.transform(held, lambda x, i: combine(
            x, F.get(held, i - width), F.get(held, i + width)))).otherwise(held)

    return F.aggregate(F.sequence(F.lit(0), F.lit(30)), items, step, finish)


def matches(text: Column, pattern: str, group: int = 0, guard: Column | None = None) -> Column:
    """All matches from left to right; ``inner`` is a group, ``before`` and ``after`` what lies around.

    ``guard`` is a cheap condition that every text with a match fulfils.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("p"), found.alias("f"), inner.alias("i"))
    pieces = F.transform(zipped, lambda x: F.struct(
        x["p"].alias("p"), x["f"].alias("f"), x["i"].alias("i"),
        (F.length(x["p"]) + F.coalesce(F.length(x["f"]), F.lit(0))).alias("end")))

    def total(x: Column, back: Column, _: Column) -> Column:
        return F.struct(x["p"].alias("p"), x["f"].alias("f"), x["i"].alias("i"),
                        (x["end"] + F.coalesce(back["end"], F.lit(0))).alias("end"))

    def told(held: Column) -> Column:
        every = F.transform(held, lambda x, i: F.struct(
            (x["end"] - F.length(x["f"])).alias("start"), x["end"].alias("end"), x["f"].alias("value"),
            x["i"].alias("inner"), F.right(x["p"], F.lit(CONTEXT)).alias("before"),
            F.left(F.get(held, i + 1)["p"], F.lit(CONTEXT)).alias("after")))
        return F.filter(every, lambda x: x["value"].isNotNull()).cast(f"array<{MATCH}>")

    some = text.rlike(pattern) if guard is None else guard & text.rlike(pattern)
    return F.when(some, doubled(pieces, total, told)).otherwise(F.array().cast(f"array<{MATCH}>"))


def as_spans(found: Column, kind: str, number: int) -> Column:
    return F.transform(found, lambda m: F.struct(
        m["start"].alias("start"), F.lit(number).alias("kind_no"), m["end"].alias("end"),
        F.lit(kind).alias("kind"), m["value"].alias("value")))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def all_in(*spans: Column) -> Column:
    return reduce(lambda a, b: F.concat(a, b), spans)


def met(base: Column, more: Column) -> Column:
    """The elements of ``more`` by start, each (item, met): does a span of ``base`` overlap it?

    Both have ``start`` and ``end``. Sorted together, an element is met if an earlier
    base span reaches beyond its start or a later one starts before its end.
    """
    def both(spans: Column, own: bool) -> Column:
        return F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end"),
            (F.lit(-1) if own else s["end"]).alias("reach"),
            (F.lit(2**31 - 1) if own else s["start"]).alias("ahead")))

    def spread(x: Column, back: Column, fore: Column) -> Column:
        return F.struct(x["start"].alias("start"), x["own"].alias("own"), x["end"].alias("end"),
                        F.greatest(x["reach"], back["reach"]).alias("reach"),
                        F.least(x["ahead"], fore["ahead"]).alias("ahead"))

    def flags(held: Column) -> Column:
        own = F.filter(held, lambda x: x["own"])
        return F.transform(own, lambda x: (x["reach"] > x["start"]) | (x["ahead"] < x["end"]))

    ordered = F.array_sort(F.concat(both(base, False), both(more, True)))
    marks = F.when(F.size(base) > 0, doubled(ordered, spread, flags)).otherwise(
        F.transform(more, lambda _: F.lit(False)))
    by_start = F.array_sort(F.transform(more, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s.alias("item"))))
    return F.transform(F.arrays_zip(by_start.alias("s"), marks.alias("met")), lambda x: F.struct(
        x["s"]["item"].alias("item"), x["met"].alias("met")))
