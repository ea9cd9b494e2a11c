"""Histograms: values are counted by bin first, so that only bins are ordered and summed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = 1e-10


def mean_normalised(df: DataFrame, column: str) -> DataFrame:
    """``column`` divided by its mean."""
    mean = df.agg(F.avg(column).alias("_mean"))
    return df.crossJoin(F.broadcast(mean)).withColumn(column, F.col(column) / F.col("_mean")).drop("_mean")  # one row


def bin_of(value: Column, low: Column, high: Column, width: Column, bins: Column) -> Column:
    """The bin of a value; the upper limit itself belongs to the last bin, values outside have none."""
    place = F.floor((value - low) / width).cast("long")
    return F.when(value == high, bins - 1).when((place >= 0) & (place < bins), place)


def _limits(df: DataFrame, column: str, width: float, low: float | None, high: float | None, pad: bool, normalise: bool) -> DataFrame:
    """One row: ``low, high, width, bins, n, mean``."""
    found = df.agg(
        F.min(column).alias("least"), F.max(column).alias("most"), F.count(column).alias("n"),
        (F.avg(column) if normalise else F.lit(1.0)).alias("mean"),
    )
    scaled = F.lit(float(width)) / F.col("mean")
    edge = scaled if pad else F.lit(0.0)
    first = F.col("least") / F.col("mean") - edge if low is None else F.lit(float(low)) / F.col("mean")
    last = F.col("most") / F.col("mean") + edge if high is None else F.lit(float(high)) / F.col("mean")
    return found.select(first.alias("low"), last.alias("high"), scaled.alias("width"), "n", "mean").withColumn(
        "bins", F.ceil((F.col("high") - F.col("low")) / F.col("width")).cast("long")
    )


def histogram_1d(
    df: DataFrame, column: str, width: float, low: float | None = None, high: float | None = None,
    normalise_mean: bool = False, trim: bool = True,
) -> DataFrame:
    """``bin, value, count, cumulative, prob, cdf`` for each bin, empty ones too.

    ``value`` is the bin's middle, ``prob`` a share of all values, ``cdf`` one of those
    inside the limits. The limits default to one width beyond the data. Nulls are left
    out. ``trim`` drops bins after the first with ``cdf`` 1.
    """
    values = df.select(F.col(column).cast("double").alias("_v")).where("_v IS NOT NULL")
    limits = _limits(values, "_v", width, low, high, True, normalise_mean)
    one = F.broadcast(limits)  # one row
    place = bin_of(F.col("_v") / F.col("mean"), F.col("low"), F.col("high"), F.col("width"), F.col("bins"))
    counts = values.crossJoin(one).select(place.alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    grid = limits.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)).alias("bin"), "low", "width", "n")
    every = grid.join(counts, "bin", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    summed = every.select(
        "bin", (F.col("low") + (F.col("bin") + 0.5) * F.col("width")).alias("value"), "count",
        F.sum("count").over(upto).alias("cumulative"), (F.col("count") / F.col("n")).alias("prob"),
        F.sum("count").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"),
    ).withColumn("cdf", F.col("cumulative") / F.col("_all"))
    if trim:
        summed = trimmed(summed, "bin")
    return summed.drop("_all")


def trimmed(histogram: DataFrame, order: str, cdf: str = "cdf") -> DataFrame:
    """Without the bins after the first whose ``cdf`` is 1."""
    before = F.lag(cdf).over(Window.orderBy(order))
    return histogram.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") < 1 - TOLERANCE)).drop("_before")


def histogram_2d(
    df: DataFrame, x: str, y: str, width: tuple[float, float],
    low: tuple[float, float] | None = None, high: tuple[float, float] | None = None, compat: bool = False,
) -> DataFrame:
    """``bin_x, bin_y, value_x, value_y, count`` on the whole grid; limits default to the data's.

    ``compat`` takes whole steps from the lower limit before it divides by the width.
    """
    values = df.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).where("_x IS NOT NULL AND _y IS NOT NULL")
    sides = {}
    for i, c in enumerate("xy"):
        limits = _limits(values, f"_{c}", width[i], low[i] if low else None, high[i] if high else None, False, False)
        sides[c] = limits.select(*[F.col(k).alias(f"{k}_{c}") for k in ("low", "high", "width", "bins")])
    both = sides["x"].crossJoin(sides["y"])  # one row

    def place(c: str) -> Column:
        low_, high_, width_, bins = (F.col(f"{k}_{c}") for k in ("low", "high", "width", "bins"))
        if not compat:
            return bin_of(F.col(f"_{c}"), low_, high_, width_, bins)
        at = (F.floor(F.col(f"_{c}") - low_) / width_).cast("long")
        return F.when(F.col(f"_{c}") == high_, bins - 1).when((at >= 0) & (at < bins), at)

    counts = (
        values.crossJoin(F.broadcast(both)).select(place("x").alias("bin_x"), place("y").alias("bin_y"))
        .where("bin_x IS NOT NULL AND bin_y IS NOT NULL").groupBy("bin_x", "bin_y").agg(F.count(F.lit(1)).alias("count"))
    )
    steps = {c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"bins_{c}") - 1)).alias(f"bin_{c}") for c in "xy"}
    grid = both.select("*", steps["x"]).select("*", steps["y"])
    return grid.join(counts, ["bin_x", "bin_y"], "left").select(
        "bin_x", "bin_y",
        *[(F.col(f"low_{c}") + (F.col(f"bin_{c}") + 0.5) * F.col(f"width_{c}")).alias(f"value_{c}") for c in "xy"],
        F.coalesce("count", F.lit(0)).alias("count"),
    )
