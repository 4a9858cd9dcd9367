"""Expressions over arrays that stay linear in their length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, combine: Callable[[Column, Column], Column], size: int = 128) -> Column:
    """For each of an array's integers the fold, from 0, of those before it. combine: associative, with 0 as its neutral element.

    Folds chunks, then their results: an array that grows within a fold is copied
    at each step, which a long array as a whole would pay with the square of its length.
    """

    def fold(part: Column, at: Column) -> Column:
        start = F.struct(at.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, start, lambda a, v: F.struct(combine(a["at"], v).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def folded(x: Column) -> Column:
        totals = F.transform(x, lambda c: F.aggregate(c, F.lit(0), combine))
        return F.flatten(F.zip_with(x, fold(totals, F.lit(0)), fold))

    return let(values, lambda v: F.when(F.size(v) > 0, let(chunks(v, size), folded)).otherwise(F.array().cast("array<int>")))


def chunks(values: Column, size: int) -> Column:
    """An array that is not empty as an array of arrays of so many elements."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / size).cast("int")), lambda k: F.slice(values, k * size + 1, F.lit(size)))
