"""Folded days: one row for several rows of a user and day that differ in their context only.

A user with several trait rows, or several change rows in a month, has a row for each pair of them on every active day. What
comes from the events is the same in all of these, so it is worked out once, on a row with the context in arrays:
``_changes`` (change flags), ``_traits`` (trait scores), and ``_first`` and ``_copies``, which say for which pairs the row stands. Pairs are
numbered from 0, the traits of the first change first. ``_place`` is the number of the first of them in the whole day: a row that stands for
one pair only may hold only that one in its arrays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from vigilume.schema import TRAITS

FOLD = ("_changes", "_traits", "_first", "_copies", "_place")
FLAGS = ("role_changed", "dept_changed", "functional_unit_changed")
SCORES = tuple(TRAITS.values())


def is_folded(days: DataFrame) -> bool:
    return set(FOLD) <= set(days.columns)


def change_of(pair: Column) -> Column:
    """The change row of a pair, by its number."""
    return F.get("_changes", F.floor(pair / F.size("_traits")).cast("int"))


def traits_of(pair: Column) -> Column:
    return F.get("_traits", (pair % F.size("_traits")).cast("int"))


def map_traits(value: Callable[[str, Column], Column]) -> Column:
    """``_traits`` with ``value(name, score)`` for every score."""
    return F.transform("_traits", lambda t: F.struct(*[value(n, t[n]).alias(n) for n in SCORES])).alias("_traits")


def trait_copies() -> Column:
    """For each row of ``_traits`` the number of pairs, among those the row stands for, that hold it."""
    n = F.size("_traits")
    below = lambda end, t: F.floor((end - t + n - 1) / n)
    return F.transform("_traits", lambda _, t: below(F.col("_first") + F.col("_copies"), t) - below(F.col("_first"), t))


def set_apart(days: DataFrame, n: int) -> DataFrame:
    """The first ``n`` pairs of every folded row as rows of their own, what is left of it as another."""
    first, copies = F.col("_first"), F.col("_copies")
    apart = days.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.least(copies - 1, F.lit(n)))).alias("_nth"))
    pair, rest = first + F.col("_nth"), F.col("_nth") == n
    own = {
        "_changes": F.when(rest, F.col("_changes")).otherwise(F.array(change_of(pair))),
        "_traits": F.when(rest, F.col("_traits")).otherwise(F.array(traits_of(pair))),
        "_first": F.when(rest, pair).otherwise(F.lit(0).cast("long")),
        "_copies": F.when(rest, copies - n).otherwise(F.lit(1).cast("long")),
        "_place": F.col("_place") + F.col("_nth"),
    }
    return apart.select(*[own[c].alias(c) if c in own else F.col(c) for c in days.columns])


def unfold(days: DataFrame, place: str | None = None) -> DataFrame:
    """A row for each pair; days that are not folded stay as they are. ``place`` adds the number of the pair in its day."""
    if not is_folded(days):
        return days
    pairs = days.select("*", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_copies") - 1)).alias("_pair"))
    change, scores = change_of(F.col("_pair")), traits_of(F.col("_pair"))
    return pairs.select(
        *[c for c in days.columns if c not in FOLD],
        *[change[f].alias(f) for f in FLAGS], *[scores[s].alias(s) for s in SCORES],
        *([(F.col("_place") + F.col("_pair") - F.col("_first")).alias(place)] if place else []),
    )
