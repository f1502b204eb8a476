"""Vector algebra on array columns, in double arithmetic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once. Inside a lambda an outer expression is evaluated for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum_products(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product; 0 for vectors of different lengths."""
    return F.when(F.size(a) == F.size(b), _sum_products(doubles(a), doubles(b))).otherwise(F.lit(0.0))


def unit(v: Column) -> Column:
    """The vector over its norm; a zero vector stays."""
    norm = lambda x: F.sqrt(_sum_products(x, x))
    return let(doubles(v), lambda x: let(norm(x), lambda n: F.when(n == 0, x).otherwise(F.transform(x, lambda t: t / n))))


def center(v: Column, c: Column) -> Column:
    """The vector without its projection on the unit vector c, normalised. No centroid leaves it as it is."""
    away = let(dot(v, c), lambda share: F.zip_with(doubles(v), doubles(c), lambda x, y: x - share * y))
    return F.when(c.isNull(), doubles(v)).otherwise(unit(away))


def half_up(x: Column) -> Column:
    """Rounding with halves towards plus infinity."""
    return F.floor(x + F.lit(0.5))


def quantize(v: Column) -> Column:
    """(q, scale): int8 components and the scale of a row; the scale of a zero row is 1."""
    most = F.array_max(F.transform(doubles(v), lambda x: F.abs(x)))
    scale = F.when(most == 0, F.lit(1.0)).otherwise(most / F.lit(127.0))
    level = lambda x, s: F.greatest(F.lit(-127), F.least(F.lit(127), half_up(x / s))).cast("tinyint")
    return let(scale, lambda s: F.struct(F.transform(doubles(v), lambda x: level(x, s)).alias("q"), s.alias("scale")))


def dequantize(q: Column, scale: Column, dims: Column | None = None) -> Column:
    """The unit vector of a quantised row; null if its length isn't ``dims``."""
    out = unit(F.transform(q, lambda x: x.cast("double") * scale))
    return out if dims is None else F.when(F.size(q) == dims, out)


def mean_by(df: DataFrame, keys: list[str], vector: str, out: str = "mean") -> DataFrame:
    """The normalised mean vector of each group: one partial aggregate per component, then one row a group."""
    parts = df.select(*keys, F.posexplode(doubles(F.col(vector))).alias("i", "x")).groupBy(*keys, "i").agg(F.avg("x").alias("x"))
    rows = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    return rows.select(*keys, unit(F.col("v.x")).alias(out))


def centroid(df: DataFrame, vector: str, dims: int | None = None) -> DataFrame:
    """One row: the unit mean of all vectors of the right length, or null if there is none or it is zero."""
    rows = df if dims is None else df.where(F.size(vector) == dims)
    parts = rows.select(F.posexplode(doubles(F.col(vector))).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x"))
    v = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda r: r["x"])
    one = parts.agg(v.alias("v"))
    return one.select(F.when((F.size("v") > 0) & (dot(F.col("v"), F.col("v")) > 0), unit(F.col("v"))).alias("centroid"))


def centered(df: DataFrame, vector: str, out: str = "v") -> DataFrame:
    """The rows with their centred vector; the centroid is one row, which is broadcast."""
    c = centroid(df, vector)
    return df.crossJoin(F.broadcast(c)).withColumn(out, center(F.col(vector), F.col("centroid"))).drop("centroid")


def median(x: Column) -> Column:
    """The middle value of a group, or the mean of the middle two."""
    return F.median(x)
