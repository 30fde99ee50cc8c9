"""Checks that relate rows to other rows, by aggregation and equi-joins only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import filled, one_of
from .skew import join_many


def count_where(condition: Column) -> Column:
    """Rows for which the condition holds; 0 when it is never true."""
    return F.count(F.when(condition, True))


def unique(df: DataFrame, key: str, ignore_blank: bool = False) -> DataFrame:
    """Rows whose key occurs more than once.

    Keys are counted with map-side partial sums and joined back, so a frequent
    key never gathers in one task as it would under a window.
    """
    keyed = df.filter(filled(key)) if ignore_blank else df.filter(F.col(key).isNotNull())
    repeated = keyed.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_key")
    return join_many(keyed, repeated, (key, "_key"), "left_semi")


def child_stats(child: DataFrame, foreign: str, **aggregates: Column) -> DataFrame:
    """One row per parent key, named `_parent`."""
    return (
        child.filter(F.col(foreign).isNotNull())
        .groupBy(F.col(foreign).alias("_parent"))
        .agg(*[value.alias(name) for name, value in aggregates.items()])
    )


def with_child_stats(parent: DataFrame, key: str, stats: DataFrame) -> DataFrame:
    """Attach per-parent figures; parents without children get NULL."""
    return join_many(parent, stats, (key, "_parent"), "left")


def child_count(parent: DataFrame, key: str, child: DataFrame, foreign: str, name: str) -> DataFrame:
    """Attach the number of children, 0 where there are none."""
    stats = child_stats(child, foreign, **{name: F.count(F.lit(1))})
    return with_child_stats(parent, key, stats).withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def references(child: DataFrame, foreign: str, parent: DataFrame, key: str, flag: str) -> DataFrame:
    """Children with their parent's columns; `flag` is true where the parent exists, else NULL."""
    return join_many(child, parent.withColumn(flag, F.lit(True)), (foreign, key), "left")


def exists_in(df: DataFrame, key: str, other: DataFrame, other_key: str, negate: bool = False) -> DataFrame:
    """Rows whose key is (or, negated, is not) among another table's keys."""
    keys = other.filter(F.col(other_key).isNotNull()).select(F.col(other_key).alias("_other")).distinct()
    return join_many(df, keys, (key, "_other"), "left_anti" if negate else "left_semi")


def key_flags(key: str, **sources: tuple[DataFrame, str]) -> DataFrame:
    """One row per key found in any source, with a boolean per source.

    Several existence tests on the same key then cost one join.
    """
    names = list(sources)
    rows = None
    for name, (df, column) in sources.items():
        part = df.filter(F.col(column).isNotNull()).select(
            F.col(column).alias(key), *[F.lit(other == name).alias(other) for other in names]
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(key).agg(*[F.max(name).alias(name) for name in names])


def event_conflict(events: DataFrame, keys: list[str], row_id: str, kind: str, **sets: tuple[str, ...]) -> DataFrame:
    """Per key (NULL keys included): how many events fall in each set and the smallest id among them."""
    figures = []
    for name, codes in sets.items():
        member = one_of(kind, *codes)
        figures += [count_where(member).alias(f"n_{name}"), F.min(F.when(member, F.col(row_id))).alias(f"id_{name}")]
    return events.groupBy(*keys).agg(*figures)


def event_repeat(events: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """Keys (NULL keys included) that occur more than once, with count and smallest id."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(row_id).alias("primero")).filter("n > 1")


def event_structure(events: DataFrame, parcel: list[str], **counts: Column) -> DataFrame:
    """Per parcel: how many of its events satisfy each condition."""
    return events.groupBy(*parcel).agg(*[count_where(condition).alias(name) for name, condition in counts.items()])
