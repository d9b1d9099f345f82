"""Change points at least a gap apart (W09), as pointers to the next row that far away, doubled in rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .resolve import dot


def difference(before: Column, now: Column) -> Column:
    return F.abs(now - before)


def correlation_gap(before: Column, now: Column) -> Column:
    """1 less the correlation of two vectors; 0 if one is constant, null if one is null, empty or their lengths differ."""
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(v)
    middle = lambda v: F.transform(v, lambda x: x.cast("double") - mean(v))
    a, b = middle(before), middle(now)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    gap = F.when(norm > 2.220446049250313e-16, 1 - dot(a, b) / norm).otherwise(F.when(norm.isNotNull(), 0.0))
    return F.when((F.size(before) == F.size(now)) & (F.size(now) > 0), gap)


def spans(at: str, width: float) -> Column:
    return F.floor(F.col(at) / width).cast("long")


def with_previous(df: DataFrame, width: float) -> DataFrame:
    """df (__key, __at, __order, __value) and __before: the value of the key's row before, in a struct; null at the first.

    A key's rows are ordered span by span, so that no key meets in one task; a span's first row takes its predecessor from the last rows of
    the spans, of which there is one a span."""
    rows = df.withColumn("__span", spans("__at", width))
    own = F.lag(F.struct("__value")).over(Window.partitionBy("__key", "__span").orderBy("__at", "__order"))
    lasts = rows.groupBy("__key", "__span").agg(F.max_by(F.struct("__value"), F.struct("__at", "__order")).alias("__last"))
    carried = lasts.select("__key", "__span", F.lag("__last").over(Window.partitionBy("__key").orderBy("__span")).alias("__carried"))
    return rows.withColumn("__own", own).join(carried, ["__key", "__span"]).withColumn("__before", F.coalesce("__own", "__carried")).drop("__own", "__carried", "__span")


def next_after(points: DataFrame, gap: float, width: float) -> DataFrame:
    """points (__key, __at), distinct -> __key, __at, __to: the key's first point at `gap` or more after it; points without one are left out.

    Each point asks at __at + gap. Questions and points are sorted backwards within a span, where the last point seen is the answer; a
    question that finds none takes the first point of the next span that has any."""
    asked = points.select("__key", F.col("__at").alias("__from"), (F.col("__at") + gap).alias("__t"), F.lit(None).cast("double").alias("__point"))
    given = points.select("__key", F.lit(None).cast("double").alias("__from"), F.col("__at").alias("__t"), F.col("__at").alias("__point"))
    rows = asked.union(given).withColumn("__span", spans("__t", width))
    back = Window.partitionBy("__key", "__span").orderBy(F.desc("__t"), F.col("__point").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = rows.withColumn("__near", F.last("__point", ignorenulls=True).over(back)).where("__from IS NOT NULL")
    firsts = rows.groupBy("__key", "__span").agg(F.min("__point").alias("__first"))
    later = Window.partitionBy("__key").orderBy(F.desc("__span")).rowsBetween(Window.unboundedPreceding, -1)
    far = firsts.select("__key", "__span", F.last("__first", ignorenulls=True).over(later).alias("__far"))
    to = F.coalesce("__near", "__far")
    return near.join(far, ["__key", "__span"]).select("__key", F.col("__from").alias("__at"), to.alias("__to")).where("__to IS NOT NULL")


def follow(starts: DataFrame, links: DataFrame, materialize: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """starts (__key, __at) and all that can be reached from them by links (__key, __at, __to).

    After k rounds the first 2^k points of each chain are found and links span 2^k steps, so the rounds are the logarithm of the
    longest chain. Rows meet by key and time, which no key's size skews."""
    found, jumps = materialize(starts.select("__key", "__at")), materialize(links)
    while True:
        new = materialize(found.join(jumps, ["__key", "__at"]).select("__key", F.col("__to").alias("__at")))
        if new.isEmpty():
            return found
        found = materialize(found.union(new))
        jumps = materialize(jumps.join(jumps.toDF("__key", "__to", "__further"), ["__key", "__to"]).select("__key", "__at", F.col("__further").alias("__to")))


def change_points(df: DataFrame, key: str, at: str, order: str, value: str, threshold: float, gap: float, materialize: Callable[[DataFrame], DataFrame], step: Callable[[Column, Column], Column] = difference, width: float | None = None) -> DataFrame:
    """W09. key, at, order of the rows kept: a key's first row, then each row whose step from the row before it is over the threshold and
    that lies `gap` (over 0) or more after the last row kept.

    `at` is a number; rows of one time stand in the order of `order`, and at most the first of those that qualify is kept. Rows
    without a key or time are left out; a row without a value, or after one, is no change, nor is a step that is NaN.
    `width` is the stretch of time whose rows of one key are sorted in a task (1000 gaps unless given). `materialize` writes and rereads a table."""
    if gap <= 0:
        raise ValueError("the gap must be over 0")
    wide = width or 1000 * gap
    column = lambda c: F.col(f"`{c}`")
    rows = df.select(column(key).alias("__key"), column(at).cast("double").alias("__at"), column(order).alias("__order"), column(value).alias("__value")).where("__key IS NOT NULL AND __at IS NOT NULL AND NOT isnan(__at)")
    moved = step(F.col("__before.__value"), F.col("__value"))
    changes = with_previous(rows, wide).where(F.col("__before").isNull() | (moved > threshold) & ~F.isnan(moved))
    points = materialize(changes.groupBy("__key", "__at").agg(F.min("__order").alias("__order")))
    starts = points.groupBy("__key").agg(F.min("__at").alias("__at"))
    kept = follow(starts, next_after(points.select("__key", "__at"), gap, wide), materialize)
    return points.join(kept, ["__key", "__at"]).select(F.col("__key").alias(key), F.col("__at").alias(at), F.col("__order").alias(order))
