"""Distribution statistics, uniformity checks and scaling constants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilequery.operators.select import numbered
from tilequery.schema import require
from tilequery.session import inline_if_small, materialize


def running_total(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Running sum of ``value`` in global order, split over range partitions."""
    parts = materialize(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    inside = F.sum(value).over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    totals = parts.groupBy("_p").agg(F.sum(value).alias("_t"))
    before = F.sum("_t").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = inline_if_small(totals.select("_p", F.coalesce(before, F.lit(0)).alias("_o")))  # one row per partition
    return parts.withColumn("_in", inside).join(offsets, "_p").withColumn(name, F.col("_in") + F.col("_o")).drop("_p", "_in", "_o")


def ecdf(df: DataFrame, column: str) -> DataFrame:
    """``value, n, cdf``: fraction of rows at or below each distinct value."""
    steps = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    run = running_total(steps, ["value"], "n", "_c")
    total = run.agg(F.max("_c").alias("_all")).scalar()  # the last running count is the number of rows
    return run.withColumn("cdf", F.col("_c") / total).select("value", "n", "cdf")


def inverse_ecdf(df: DataFrame, column: str, p: float | list[float]) -> float | list[float]:
    """Value at which the ECDF reaches ``p``, linear between its steps; several ``p`` share one pass.

    Below the first step or above 1 there is no value (``ValueError``).
    """
    ps = [float(v) for v in (p if isinstance(p, (list, tuple)) else [p])]
    at = F.struct("cdf", "value")
    aggs = []
    for n, q in enumerate(ps):
        aggs += [F.max(F.when(F.col("cdf") <= q, at)).alias(f"lo{n}"), F.min(F.when(F.col("cdf") >= q, at)).alias(f"hi{n}")]
    row = ecdf(df, column).agg(*aggs).first()
    out = []
    for n, q in enumerate(ps):
        lo, hi = row[f"lo{n}"], row[f"hi{n}"]
        if lo is None or hi is None:
            raise ValueError(f"{q} is outside the range of the distribution of {column!r}")
        t = (q - lo["cdf"]) / (hi["cdf"] - lo["cdf"]) if hi["cdf"] > lo["cdf"] else 0.0
        out.append(float(lo["value"] + t * (hi["value"] - lo["value"])))
    return out if isinstance(p, (list, tuple)) else out[0]


def histogram(df: DataFrame, column: str, lo: float, hi: float, bins: int = 25) -> DataFrame:
    """Counts in equal bins on ``[lo, hi]``; the last bin is closed, values outside are left out."""
    v, width = F.col(column), (float(hi) - float(lo)) / bins
    b = F.least(F.floor((v - F.lit(float(lo))) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.filter(v.between(float(lo), float(hi))).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return all_bins.join(counts, "bin", "left").select(
        "bin",
        (F.col("bin") * F.lit(width) + F.lit(float(lo))).alias("left_edge"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )


def distance_histograms(dists: DataFrame, threshold: float, near: str = "an_dist", far: str = "ad_dist") -> DataFrame:
    """25-bin histograms on ``[0, 5 * threshold]`` of near and far distances."""
    a = histogram(dists, near, 0.0, 5.0 * threshold, 25).withColumn("kind", F.lit(near))
    return a.unionByName(histogram(dists, far, 0.0, 5.0 * threshold, 25).withColumn("kind", F.lit(far)))


def channel_stats(moments: DataFrame, column: str = "m") -> DataFrame:
    """Per-channel mean and sample standard deviation over all pixels of all images.

    ``column`` holds :func:`tilequery.functions.pixels.moments`.
    """
    rows = moments.select(F.col(f"{column}.n").alias("n"), F.posexplode(F.arrays_zip(f"{column}.s", f"{column}.q")).alias("channel", "m"))
    total = rows.groupBy("channel").agg(F.sum("n").alias("n"), F.sum("m.s").alias("s"), F.sum("m.q").alias("q"))
    mean = F.col("s") / F.col("n")
    return total.select("channel", mean.alias("mean"), F.sqrt((F.col("q") - F.col("s") * mean) / (F.col("n") - 1)).alias("std"))


def assert_uniform(df: DataFrame, *columns: str) -> tuple:
    """The one value all rows share in ``columns``; anything else is an error."""
    rows = df.select(*columns).distinct().take(2)
    if len(rows) != 1:
        raise ValueError(f"{columns} differ between rows: {[tuple(r) for r in rows]}")
    return tuple(rows[0])


def spacing(df: DataFrame, column: str) -> DataFrame:
    """Distinct sorted values with the step from the value before (NULL for the first)."""
    rows = materialize(numbered(df.select(column).distinct(), column, name="_r"))
    before = rows.select((F.col("_r") + 1).alias("_r"), F.col(column).alias("_v"))
    return rows.join(before, "_r", "left").select(column, (F.col(column) - F.col("_v")).alias("step"))


def uniform_spacing(df: DataFrame, column: str) -> float:
    """The one step between sorted distinct values; uneven steps are an error."""
    return assert_uniform(spacing(df, column).filter("step is not null"), "step")[0]


def min_max(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """``lo_c, hi_c`` for each column (one row, or one per group)."""
    aggs = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]
    return df.groupBy(*(by or [])).agg(*aggs)


def cumulative_variance(ratios: DataFrame, column: str = "explained_variance", order: str = "component") -> DataFrame:
    """Running sum over components (a table of one row per component), rounded to 2 digits."""
    require(ratios, column, order)
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return ratios.withColumn("cumulative", F.sum(F.round(column, 2)).over(w))


def cluster_sizes(df: DataFrame, by: str = "cluster_id", letters: bool = False) -> DataFrame:
    """Tiles per cluster; with letters the label reads ``count\\nA``."""
    from tilequery.functions.names import letter

    n = df.groupBy(by).agg(F.count("*").alias("n_tiles"))
    text = F.col("n_tiles").cast("string")
    return n.withColumn("label", F.concat(text, F.lit("\n"), letter(F.col(by))) if letters else text)
