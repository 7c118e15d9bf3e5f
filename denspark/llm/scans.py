"""Running totals and cuts inside one row, with native functions and in time that is linear in its length.

A fold that appends to an array copies it at every step. Here an array is folded in chunks of
``CHUNK`` values, their totals in chunks again, and each value starts from its chunk's total, so
what is copied stays short.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values of a chunk, and code points of a block of text.
CHUNK, BLOCK = 32, 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, zero: Column, add: Callable[[Column, Column], Column], levels: int = 3) -> Column:
    """For each value of a non-empty array, ``add`` over all before it, from ``zero`` (whose type the result has)."""
    empty = F.slice(F.array(zero), 1, 0)

    def fold(at: Column, steps: Column, value: Callable[[Column], Column]) -> Column:
        start = F.struct(at.alias("at"), empty.alias("out"))
        return F.aggregate(steps, start, lambda a, j: F.struct(add(a["at"], value(j)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    if levels == 0:
        return fold(zero, values, lambda x: x)
    n = F.size(values)
    chunks = F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int"))

    def steps(i: Column) -> Column:
        return F.sequence(i * CHUNK, F.least(i * CHUNK + (CHUNK - 1), n - 1))

    totals = F.transform(chunks, lambda i: F.aggregate(steps(i), zero, lambda a, j: add(a, F.get(values, j))))
    return let(totals, lambda t: let(running(t, zero, add, levels - 1), lambda before: F.flatten(F.transform(chunks, lambda i: fold(F.get(before, i), steps(i), lambda j: F.get(values, j))))))


def sums_before(values: str, levels: int = 3) -> str:
    """SQL: for each value of a non-empty array<bigint> (a name) the sum of all before it, as :func:`running` gives it.

    As text it is parsed in one go, where columns are built call by call.
    """

    def fold(at: str, steps: str, value: str) -> str:
        start = f"named_struct('at', {at}, 'out', cast(array() as array<bigint>))"
        return f"aggregate({steps}, {start}, (a, j) -> named_struct('at', a.at + {value}, 'out', array_append(a.out, a.at)), a -> a.out)"

    if levels == 0:
        return fold("0L", values, "j")
    chunks = f"sequence(0, (size({values}) - 1) div {CHUNK})"
    steps = f"sequence(i * {CHUNK}, least(i * {CHUNK} + {CHUNK - 1}, size({values}) - 1))"
    totals = f"transform({chunks}, i -> aggregate({steps}, 0L, (a, j) -> a + get({values}, j)))"
    each = f"flatten(transform({chunks}, i -> {fold(f'get(b{levels}, i)', steps, f'get({values}, j)')}))"
    return f"get(transform(array({totals}), t{levels} -> get(transform(array({sums_before(f't{levels}', levels - 1)}), b{levels} -> {each}), 0)), 0)"


def blocks(text: Column) -> Column:
    """A text as an array of BLOCK code points each (the last may have fewer)."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def part(blocks_of_text: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` (exclusive) of a text given as :func:`blocks`; its cost doesn't grow with ``start``."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int")
    skip = (start % BLOCK).cast("int") + 1
    one = F.substring(F.get(blocks_of_text, first), skip, (end - start).cast("int"))
    between = F.when(last - first > 1, F.array_join(F.transform(F.sequence(first + 1, last - 1), lambda k: F.get(blocks_of_text, k)), "")).otherwise("")
    several = F.concat(F.substring(F.get(blocks_of_text, first), skip, F.lit(BLOCK)), between, F.substring(F.get(blocks_of_text, last), F.lit(1), ((end - 1) % BLOCK).cast("int") + 1))
    return F.when(end <= start, F.lit("")).when(first == last, one).otherwise(several)
