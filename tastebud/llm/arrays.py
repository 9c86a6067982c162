"""Array and text expressions whose cost grows with their input, not with its square.

Column expressions inside a lambda are evaluated again for every element, an
array that grows by appending is copied at every step, and a substring is found
by counting from the start. The helpers bind a value once, form running values
in blocks, and cut texts by blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256  # elements of a running block
CUT_BITS = 9  # texts are cut from blocks of 512 code points


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, zero: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Inclusive running values of an array under an associative ``op`` with unit ``zero``."""
    def append(acc, x):
        return let(op(acc["at"], x), lambda y: F.struct(y.alias("at"), F.array_append(acc["out"], y).alias("out")))

    def begin(at):
        return F.struct(at.alias("at"), F.slice(F.array(zero), 1, 0).alias("out"))

    def over(v):
        numbers = F.when(F.size(v) > 0, F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))).otherwise(
            F.array().cast("array<int>"))
        return let(F.transform(numbers, lambda b: F.slice(v, b * BLOCK + 1, BLOCK)), blocks)

    def blocks(parts):
        totals = F.transform(parts, lambda p: F.aggregate(p, zero, op))
        upto = F.aggregate(totals, begin(zero), append, lambda acc: acc["out"])
        before = F.slice(F.concat(F.array(zero), upto), F.lit(1), F.size(parts))
        return F.flatten(F.zip_with(parts, before, lambda p, at: F.aggregate(p, begin(at), append, lambda acc: acc["out"])))

    return let(values, over)


def cut_blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{1 << CUT_BITS}}}"), F.lit(0))


def cut(blocks: Column, start: Column, length: Column) -> Column:
    """``length`` code points of a text from ``start`` (from 0), given as its ``cut_blocks``."""
    near = F.array_join(F.slice(blocks, F.shiftright(start, CUT_BITS) + 1, F.shiftright(length, CUT_BITS) + 2), "")
    return F.substring(near, start.bitwiseAND(F.lit((1 << CUT_BITS) - 1)) + 1, length)


def united(spans: Column) -> Column:
    """Spans (with start and end, by start) as (start, end) of their unions; spans that only touch stay apart."""
    def over(s):
        highest = running(F.transform(s, lambda x: x["end"]), F.lit(0), lambda a, b: F.greatest(a, b))
        return let(highest, lambda h: both(s, h))

    def both(s, h):
        earlier = F.slice(F.concat(F.array(F.lit(-1)), h), F.lit(1), F.size(s))
        first = F.filter(F.zip_with(s, earlier, lambda x, e: F.struct(x["start"].alias("at"), (x["start"] >= e).alias("ok"))), lambda x: x["ok"])
        later = F.transform(F.slice(s, F.lit(2), F.size(s)), lambda x: x["start"])
        last = F.filter(F.zip_with(h, later, lambda e, n: F.struct(e.alias("at"), F.coalesce(n >= e, F.lit(True)).alias("ok"))), lambda x: x["ok"])
        return F.zip_with(first, last, lambda a, b: F.struct(a["at"].alias("start"), b["at"].alias("end")))

    return let(spans, over)


def outside(text: Column, spans: Column) -> Column:
    """The pieces of ``text`` before, between and after ``united`` spans."""
    def over(s):
        starts = F.concat(F.array(F.lit(0)), F.transform(s, lambda x: x["end"]))
        ends = F.concat(F.transform(s, lambda x: x["start"]), F.array(F.length(text)))
        return let(cut_blocks(text), lambda b: F.zip_with(starts, ends, lambda x, y: cut(b, x, y - x)))

    return let(spans, over)
