"""Array expressions: a bound value, a running state. No Python runs on executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items that a fold appends to one array; longer inputs are folded in chunks, so that
#: appending stays linear in practice.
CHUNK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once: an expression that stands in a lambda
    is evaluated anew for each element, a lambda's variable isn't."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(items: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The states after each item: ``step(state, item)`` from ``zero`` on, as an array as long as ``items``."""
    last = lambda states: F.element_at(states, -1)
    rest = lambda states: F.slice(states, F.lit(2), F.greatest(F.size(states) - 1, F.lit(0)))
    run = lambda chunk, state: F.aggregate(chunk, F.array(state), lambda states, x: F.concat(states, F.array(step(last(states), x))))
    first = F.struct(F.array(zero).alias("now"), F.filter(F.array(F.array(zero)), lambda _: F.lit(False)).alias("done"))

    def chunked(xs: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest((F.size(xs) - 1) / CHUNK, F.lit(0)).cast("int"))
        return F.aggregate(
            F.transform(starts, lambda c: F.slice(xs, c * CHUNK + 1, F.lit(CHUNK))),
            first,
            lambda acc, chunk: F.struct(run(chunk, last(acc["now"])).alias("now"), F.concat(acc["done"], F.array(rest(acc["now"]))).alias("done")),
            lambda acc: F.flatten(F.concat(acc["done"], F.array(rest(acc["now"])))),
        )

    return let(items, chunked)
