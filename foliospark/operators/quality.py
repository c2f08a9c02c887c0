"""Image quality of grey tiles (arrays of pixels), and the gate on it."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# The gate's limits.
SHARPNESS, DARK, BRIGHT, CONTRAST = 2.0, 25.0, 245.0, 15.0
_RAW = [math.exp(-0.5 * k * k) for k in range(-4, 5)]
GAUSS = {k - 4: v / sum(_RAW) for k, v in enumerate(_RAW)}


def _mirror(i: Column, n: int) -> Column:
    """Index with the edge pixel repeated."""
    return F.when(i < 0, -i - 1).when(i >= n, 2 * n - 1 - i).otherwise(i)


def filtered(pixels: Column, n: int, down: bool, kernel: dict[int, float]) -> Column:
    """An n x n tile (row by row) filtered along one axis."""

    def one(p: Column) -> Column:
        y, x = F.floor(p / n).cast("int"), (p % n).cast("int")
        at = lambda k: F.get(pixels, _mirror(y + k, n) * n + x if down else y * n + _mirror(x + k, n))
        return reduce(lambda a, b: a + b, (at(k) * w for k, w in kernel.items()))

    return F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), one)


def quality_metrics(tiles: DataFrame, n: int) -> DataFrame:
    """(file_id, sharpness, brightness, contrast) of tiles(file_id, pixels): excess kurtosis of the gradient of the smoothed tile, mean, population deviation."""
    smooth, edge = {-1: 1.0, 0: 2.0, 1: 1.0}, {-1: -1.0, 1: 1.0}
    t = tiles.withColumn("_a", filtered(F.col("pixels"), n, True, GAUSS)).withColumn("_b", filtered(F.col("_a"), n, False, GAUSS))
    t = t.withColumn("_dy", filtered(F.col("_b"), n, True, edge)).withColumn("_dx", filtered(F.col("_b"), n, False, edge))
    t = t.withColumn("_sy", filtered(F.col("_dy"), n, False, smooth)).withColumn("_sx", filtered(F.col("_dx"), n, True, smooth))
    g = t.select("file_id", "pixels", F.zip_with("_sx", "_sy", lambda a, b: F.sqrt(a * a + b * b)).alias("g"))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    g = g.withColumns({"_m": mean("g"), "_p": mean("pixels")})
    moment = lambda a, m, k: mean(F.transform(a, lambda v: F.pow(v - m, F.lit(k))))
    g = g.withColumns({"_m2": moment("g", F.col("_m"), 2), "_m4": moment("g", F.col("_m"), 4), "_p2": moment("pixels", F.col("_p"), 2)})
    return g.select("file_id", F.when(F.col("_m2") > 0, F.col("_m4") / (F.col("_m2") * F.col("_m2")) - 3).otherwise(0.0).alias("sharpness"), F.col("_p").alias("brightness"), F.sqrt("_p2").alias("contrast"))


def quality_gate(metrics: DataFrame, sharpness: float = SHARPNESS, dark: float = DARK, bright: float = BRIGHT, contrast: float = CONTRAST) -> DataFrame:
    """Adds passed and reason. Null metrics pass, with zeros."""
    s, b, c = (F.col(k) for k in ("sharpness", "brightness", "contrast"))
    reasons = F.array_compact(F.array(
        F.when(s < sharpness, F.format_string(f"poor sharpness (score=%.2f, threshold={sharpness})", s)),
        F.when(b < dark, F.format_string("image too dark (brightness=%.1f)", b)),
        F.when(b > bright, F.format_string("image overexposed (brightness=%.1f)", b)),
        F.when(c < contrast, F.format_string("low contrast (contrast=%.1f)", c)),
    ))
    out = metrics.withColumn("_r", reasons)
    return out.select("file_id", *[F.coalesce(F.round(k, 2), F.lit(0.0)).alias(k) for k in ("sharpness", "brightness", "contrast")], (F.size("_r") == 0).alias("passed"), F.when(F.size("_r") > 0, F.concat(F.lit("Quality check failed: "), F.array_join("_r", "; "))).alias("reason"))


def quality_force(results: DataFrame, force: bool) -> DataFrame:
    return results.withColumn("passed", F.col("passed") | F.lit(force))


def quality_summary(results: DataFrame, batch: str) -> DataFrame:
    return results.groupBy(batch).agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.bool_and("passed").alias("all_pass"))
