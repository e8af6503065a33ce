"""Array expressions shared by the text and metric operators.

All of them are linear or n log n in the array length and stay inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    An expression used inside a lambda is otherwise re-evaluated for every array element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def run_starts(items: Column) -> Column:
    """Zero-based positions at which a new value begins in a sorted array."""
    return F.filter(
        F.sequence(F.lit(0), F.size(items)),
        lambda i: (i < F.size(items))
        & ((i == 0) | ~F.get(items, i).eqNullSafe(F.get(items, i - 1))),
    )


def value_counts(items: Column) -> Column:
    """``array<struct<value, n>>``, one entry per distinct value, ordered by value."""

    def counted(ordered: Column) -> Column:
        return let(
            run_starts(ordered),
            lambda starts: F.transform(
                starts,
                lambda start, k: F.struct(
                    F.get(ordered, start).alias("value"),
                    (F.coalesce(F.get(starts, k + 1), F.size(ordered)) - start).alias("n"),
                ),
            ),
        )

    return let(F.sort_array(items), counted)


def multiset_overlap(left: Column, right: Column) -> Column:
    """Size of the multiset intersection of two string arrays.

    Both sides get a one-letter tag behind a separator, are sorted together as plain strings and
    counted by runs, so equal values of the two sides become neighbours; no value is searched for
    in the other array.
    """
    tagged = F.concat(
        F.transform(left, lambda v: F.concat(v, F.lit("\x00a"))),
        F.transform(right, lambda v: F.concat(v, F.lit("\x00b"))),
    )

    def matched(runs: Column) -> Column:
        def shared(run: Column, k: Column) -> Column:
            twin = F.get(runs, k - 1)
            is_twin = F.concat(F.rtrim(run["value"], F.lit("b")), F.lit("a")) == twin["value"]
            return F.when(
                F.endswith(run["value"], F.lit("\x00b")) & is_twin, F.least(run["n"], twin["n"])
            ).otherwise(0)

        return F.aggregate(F.transform(runs, shared), F.lit(0), lambda acc, n: acc + n)

    return let(value_counts(tagged), matched)


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of ``n`` consecutive tokens, joined by U+0001."""
    if n == 1:
        return tokens
    return let(
        tokens,
        lambda t: F.when(
            F.size(t) >= n,
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(1))),
                lambda i: F.array_join(F.slice(t, i, n), "\x01"),
            ),
        ).otherwise(F.array().cast("array<string>")),
    )


def sum_of(items: Column, zero: str = "double") -> Column:
    return F.aggregate(items, F.lit(0).cast(zero), lambda acc, v: acc + v.cast(zero))


def softmax(scores: Column) -> Column:
    """Max-shifted softmax with the denominator kept at or above 1e-12."""

    def scaled(exps: Column) -> Column:
        return let(
            F.greatest(sum_of(exps), F.lit(1e-12)),
            lambda total: F.transform(exps, lambda e: e / total),
        )

    return let(
        scores,
        lambda s: let(
            F.array_max(s),
            lambda top: let(F.transform(s, lambda v: F.exp(v - top)), scaled),
        ),
    )


def sigmoid(score: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def finite(value: Column) -> Column:
    """``value`` as double, with NaN and infinities turned into null."""
    number = value.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != F.lit(float("inf"))), number)
