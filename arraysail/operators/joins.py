"""Joins on labels, positions, intervals and coordinates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arraysail.errors import LabelError
from arraysail.operators.windows import global_position


def align(source: DataFrame, target: DataFrame, on: str, position: str, check: bool = True) -> DataFrame:
    """The rows of ``source`` for each row of ``target``, which brings the order in its ``position`` (JN01).

    Source labels must be unique and hold every target label; with ``check``
    one aggregate and one anti join make sure of it.
    """
    if check:
        if not source.groupBy(on).count().where("count > 1").isEmpty():
            raise LabelError(f"labels in {on} of the source are not unique")
        if not target.join(source, on, "left_anti").isEmpty():
            raise LabelError(f"the source lacks labels in {on} of the target")
    return target.select(on, position).join(source, on, "left")


def merge(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Inner join on shared names (JN02)."""
    return left.join(right, on, "inner")


def lookup(df: DataFrame, mapping: DataFrame, on: str, most_rows: int = 1_000_000) -> DataFrame:
    """Inner join with a mapping (JN03): broadcast up to ``most_rows`` rows, which are counted, else left to the planner."""
    small = mapping.limit(most_rows + 1).count() <= most_rows
    return df.join(F.broadcast(mapping) if small else mapping, on, "inner")


def positional(left: DataFrame, right: DataFrame, left_order: str, right_order: str, position: str = "pos") -> DataFrame:
    """Joins the n-th rows of both sides (JN04, JN05); the orders must be total."""
    return global_position(left, left_order, position).join(global_position(right, right_order, position), position)


def membership(df: DataFrame, sets: DataFrame, on: str, number: str = "set") -> DataFrame:
    """The last set (by number) that holds each label, null for none (JN06)."""
    return df.join(sets.groupBy(on).agg(F.max(number).alias(number)), on, "left")


def interval(events: DataFrame, signal: DataFrame, by: Sequence[str], event_time: Column, signal_time: Column, low: float, high: float) -> DataFrame:
    """Signal rows from ``low`` to ``high`` around each event (JN07).

    Times are numbers in one unit. Both sides are cut into buckets as wide as
    the interval, an event meets the two or three buckets that it reaches: an
    equi-join of bounded fan-out, whatever the length of the recording.
    """
    width = float(max(high - low, 1e-9))
    bucket = lambda t: F.floor(t / F.lit(width)).cast("long")
    by = list(by)
    e = events.withColumn("__t", event_time.cast("double"))
    e = e.withColumn("__b", F.explode(F.sequence(bucket(F.col("__t") + F.lit(low)), bucket(F.col("__t") + F.lit(high)))))
    s = signal.withColumn("__s", signal_time.cast("double")).withColumn("__b", bucket(F.col("__s")))
    got = e.join(s, [*by, "__b"]).where(F.col("__s").between(F.col("__t") + F.lit(low), F.col("__t") + F.lit(high)))
    return got.withColumn("offset", F.col("__s") - F.col("__t")).drop("__b", "__t", "__s")


def pairs(cells: DataFrame, item: str, inner: str, value: str = "value", diagonal: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """(by, i, j, x, y) for all pairs of items that share an inner label (JN10); quadratic in the items of an inner label."""
    by = list(by)
    a = cells.select(*by, inner, F.col(item).alias("i"), F.col(value).alias("x"))
    b = cells.select(*by, inner, F.col(item).alias("j"), F.col(value).alias("y"))
    return a.join(b, [*by, inner]).where(F.col("i") <= F.col("j") if diagonal else F.col("i") < F.col("j"))


def resample(points: DataFrame, volume: DataFrame, shape: Sequence[int], coords: Sequence[str] = ("x", "y", "z"), value: str = "value", order: int = 0) -> DataFrame:
    """Values of a grid at points, (point columns, value): nearest cell (order 0) or linear (order 1); outside, the edge holds (JN08).

    NaN counts as nought. Each point meets one or 2^d cells in an equi-join.
    """
    if order not in (0, 1):
        raise ValueError("order is 0 or 1")
    own = points.columns
    v = volume.select(*[F.col(c).cast("long").alias(f"__{c}") for c in coords], F.coalesce(F.nanvl(F.col(value).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("__v"))
    p = points.withColumn("__w", F.lit(1.0))
    for c, n in zip(coords, shape):
        x = F.least(F.greatest(F.col(c).cast("double"), F.lit(0.0)), F.lit(float(n - 1)))
        if order == 0:
            p = p.withColumn(f"__{c}", F.bround(x).cast("long"))
        else:
            low = F.least(F.floor(x), F.lit(n - 1)).cast("long")
            both = F.array(F.struct(low.alias("k"), (F.lit(1.0) - (x - low)).alias("w")), F.struct(F.least(low + 1, F.lit(n - 1)).cast("long").alias("k"), (x - low).alias("w")))
            p = p.withColumn("__c", F.explode(both)).withColumn(f"__{c}", F.col("__c.k")).withColumn("__w", F.col("__w") * F.col("__c.w")).drop("__c")
    got = p.where("__w > 0").join(v, [f"__{c}" for c in coords], "left")
    return got.groupBy(*own).agg(F.sum(F.col("__w") * F.coalesce("__v", F.lit(0.0))).alias(value))


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
