"""Filter banks as tables, in closed form (GEN01)."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CURVATURES = (0.0, 0.05, 0.1, 0.2)


def _grid(spark: SparkSession, axes: Mapping[str, Sequence[float] | int]) -> DataFrame:
    """All combinations of axes, each of doubles or of the numbers below a count.

    From one range: a join of axes multiplies their tasks.
    """
    sizes = [a if isinstance(a, int) else len(a) for a in axes.values()]
    below = math.prod(sizes)
    f = spark.range(below)
    for (name, a), n in zip(axes.items(), sizes, strict=True):
        below //= max(n, 1)
        place = F.pmod(F.floor(F.col("id") / F.lit(max(below, 1))), F.lit(max(n, 1))).cast("int")
        f = f.withColumn(name, place if isinstance(a, int) else F.get(F.array(*[F.lit(float(v)) for v in a]), place).cast("double"))
    return f.drop("id")


def curved_filters(spark: SparkSession, orientations: int = 16, curvatures: Sequence[float] = CURVATURES, sizes: Sequence[float] = (5,), frequencies: Sequence[float] = (1.2,), side: int = 9, gamma: float = 1.0, spread: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(curvature, size, theta, frequency, row, col, value): waves under a bent Gaussian, with a mean of nought."""
    half = side // 2
    thetas = [2 * math.pi * i / orientations for i in range(orientations)]
    f = _grid(spark, {"curvature": curvatures, "size": sizes, "theta": thetas, "frequency": frequencies, "row": side, "col": side})
    x, y = F.col("row") - half, half - F.col("col")
    along = x * F.cos("theta") + y * F.sin("theta")
    across = y * F.cos("theta") - x * F.sin("theta")
    bent = along + F.col("curvature") * across * across
    u, v = bent / spread[0], across / (F.col("size") * spread[1])
    bell = F.exp(-(u * u + v * v) * F.col("frequency") * F.col("frequency") / 2)
    raw = gamma * bell * (F.cos(F.col("frequency") * bent) - math.exp(-spread[0] / 2))
    keys = ["curvature", "size", "theta", "frequency"]
    return f.withColumn("value", raw).withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy(*keys)))


def random_filters(spark: SparkSession, outputs: int, inputs: int, side: int, seed: int = 27) -> DataFrame:
    """(output, input, row, col, value): uniform numbers from a hash, with a mean of nought in each (output, input)."""
    f = _grid(spark, {"output": outputs, "input": inputs, "row": side, "col": side})
    h = F.md5(F.concat_ws("-", F.lit(seed), *[F.col(c).cast("string") for c in ("output", "input", "row", "col")]))
    u = F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / float(1 << 32)
    return f.withColumn("value", u).withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy("output", "input")))
