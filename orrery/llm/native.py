"""Array functions made of built-in ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that one step of a running sum takes; the work is this often the array's length.
STRIDE = 256


def let(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make(value)``, with ``value`` computed once however often it is used."""
    return F.transform(F.array(value), make)[0]


def running(numbers: Column, begin: int = 0) -> Column:
    """Sums of all elements before each, from ``begin`` on: an array of integers as long as ``numbers``.

    Arrays that grow element by element are copied each time, so sums grow within strides
    and over strides only: for n elements, n * STRIDE + (n / STRIDE)**2 copies.
    """
    empty = F.array().cast("array<int>")

    def grown(values: Column, first: int) -> Column:
        step = lambda acc, x: F.struct(F.concat(acc["out"], F.array(acc["at"])).alias("out"), (acc["at"] + x).alias("at"))
        return F.aggregate(values, F.struct(empty.alias("out"), F.lit(first).cast("int").alias("at")), step)

    def strided(all: Column) -> Column:
        many = F.ceil(F.size(all) / F.lit(STRIDE)).cast("int")
        strides = F.transform(F.sequence(F.lit(0), many - 1), lambda k: grown(F.slice(all, k * STRIDE + 1, F.lit(STRIDE)), 0))
        shifted = lambda own: F.flatten(F.zip_with(own, grown(F.transform(own, lambda s: s["at"]), begin)["out"], lambda s, first: F.transform(s["out"], lambda x: x + first)))
        return let(strides, shifted)

    return let(numbers, lambda all: F.when(F.size(all) <= STRIDE, grown(all, begin)["out"]).otherwise(strided(all)))
