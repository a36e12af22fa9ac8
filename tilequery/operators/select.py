"""Row and column selection, reshaping, ordering and set operators."""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilequery.schema import TILE_TYPES, require
from tilequery.session import bounded_rows, broadcast_if_small, inline_if_small, materialize


def of_type(df: DataFrame, tile_type: str) -> DataFrame:
    """Rows of one tile type."""
    if tile_type not in TILE_TYPES:
        raise ValueError(f"unknown tile type {tile_type!r}; one of {TILE_TYPES}")
    return require(df, "tile_type").filter(F.col("tile_type") == tile_type)


def component(df: DataFrame, *ks: int, vector: str = "embedding", prefix: str = "c") -> DataFrame:
    """Chosen vector components as columns ``c0, c7, …``; the vector is dropped."""
    return df.select("*", *[F.get(vector, F.lit(k)).cast("double").alias(f"{prefix}{k}") for k in ks]).drop(vector)


def near_only(df: DataFrame, threshold: float, column: str = "an_dist") -> DataFrame:
    """Rows strictly nearer than ``threshold``."""
    return require(df, column).filter(F.col(column) < F.lit(threshold))


def filter_scenes(df: DataFrame, pattern: str, column: str = "scene_id") -> DataFrame:
    """Scenes whose id matches a regular expression from its start."""
    return df.filter(F.col(column).cast("string").rlike("^(?:" + pattern + ")"))


def slice_xy(df: DataFrame, x: tuple = (None, None), y: tuple = (None, None)) -> DataFrame:
    """Closed coordinate ranges; ``None`` leaves an end open."""
    for name, span in (("x", x), ("y", y)):
        lo, hi = span or (None, None)
        if lo is not None:
            df = df.filter(F.col(name) >= lo)
        if hi is not None:
            df = df.filter(F.col(name) <= hi)
    return df


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return require(df, *mapping).withColumnsRenamed(mapping)


def to_grid(df: DataFrame, x: str, y: str, value: str, xs: list | None = None) -> DataFrame:
    """One row per ``y``, one column per ``x``. ``xs`` names the columns without a look at the data."""
    xs = xs if xs is not None else sorted(
        r[0] for r in bounded_rows(df.select(x).distinct(), 10_000, f"distinct {x}")
    )
    return df.groupBy(y).pivot(x, xs).agg(F.first(value))


def explode_dims(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Long form: one row per component, with its position ``emb_dim``."""
    keep = [c for c in df.columns if c != vector]
    return df.select(*keep, F.posexplode(vector).alias("emb_dim", "value"))


def collect_dims(df: DataFrame, key: str | list[str], vector: str = "embedding") -> DataFrame:
    """Inverse of :func:`explode_dims`: arrays ordered by ``emb_dim``."""
    pairs = F.array_sort(F.collect_list(F.struct("emb_dim", "value")))
    keys = [key] if isinstance(key, str) else key
    return df.groupBy(*keys).agg(F.transform(pairs, lambda p: p["value"]).alias(vector))


def one_scene(df: DataFrame, scene_id) -> DataFrame:
    """One scene (a partition filter on stored tables)."""
    return df.filter(F.col("scene_id") == F.lit(scene_id))


def with_attrs(df: DataFrame, **attrs) -> DataFrame:
    """Attributes as constant columns."""
    return df.withColumns({k: F.lit(v) for k, v in attrs.items()})


def pop_attrs(df: DataFrame, *names: str) -> tuple[DataFrame, dict]:
    """Constant columns turned back into attributes; more than one value is an error."""
    rows = bounded_rows(df.select(*names).distinct(), 1, f"attributes {names}")
    return df.drop(*names), rows[0].asDict() if rows else {}


def to_km(df: DataFrame, x: str = "x", y: str = "y", units: str = "units") -> DataFrame:
    """Scale x and y from m to km where ``units`` says m."""
    metres = F.col(units) == "m"
    return df.withColumns(
        {
            x: F.when(metres, F.col(x) / 1000.0).otherwise(F.col(x)),
            y: F.when(metres, F.col(y) / 1000.0).otherwise(F.col(y)),
            units: F.when(metres, F.lit("km")).otherwise(F.col(units)),
        }
    )


def pick(df: DataFrame, ids: list[int], label: Column | None = None, key: str = "tile_id") -> DataFrame:
    """Rows of a list of ids, in list order, as often as listed; optional ``label`` column."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(n, int(i)) for n, i in enumerate(ids)], f"pos int, {key} long")
    out = df.join(broadcast_if_small(wanted), key)
    if label is not None:
        out = out.withColumn("label", label)
    return out.orderBy("pos")


def template_label(template: str, *columns: str) -> Column:
    """``"{} ({})"`` filled with columns in turn."""
    return F.format_string(template.replace("%", "%%").replace("{}", "%s"), *[F.col(c).cast("string") for c in columns])


def first_tiles(df: DataFrame, n: int, key: str = "tile_id") -> DataFrame:
    return df.orderBy(key).limit(n)


def numbered(df: DataFrame, *order: Column | str, name: str = "row") -> DataFrame:
    """Global dense numbering 0, 1, … in the given order, without a single-task window.

    One range shuffle, stored; positions are ``offset of the partition + place in
    it``, and only the per-partition counts are put in sequence.
    """
    parts = materialize(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    )
    part, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    counts = parts.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = F.coalesce(
        F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    offsets = counts.select("_p", before.alias("_o"))  # one row per partition
    return (
        parts.withColumn("_p", part)
        .join(inline_if_small(offsets), "_p")
        .withColumn(name, F.col("_o") + place)
        .drop("_p", "_o", "_m")
    )


def in_order(df: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """All rows in the given order: numbered 0, 1, … in ``name`` and laid out so, partition after partition, as a write keeps them.

    A range shuffle on the number; no task sees more than its range.
    """
    return numbered(df, *order, name=name).repartitionByRange(name).sortWithinPartitions(name)


def tiles_in_order(df: DataFrame, scene: str = "scene_id", x: str = "x", y: str = "y", key: str = "tile_id") -> DataFrame:
    """Tiles of each scene from west to east, then from south to north; tiles at one place by id."""
    return in_order(df, scene, x, y, key)


#: rows of one range bucket, and the largest number of buckets
BUCKET_ROWS, MAX_BUCKETS = 1_000_000, 10_000


def range_buckets(df: DataFrame, column: str, name: str = "_b") -> tuple[DataFrame, int]:
    """Even-sized buckets along a numeric column, numbered in its order, and their number.

    Lets a window over a whole sequence be cut at known places. Up to
    ``BUCKET_ROWS`` rows there is a single bucket; otherwise the boundaries come
    from approximate percentiles (any boundaries give right results).
    """
    total = df.count()
    n = min(MAX_BUCKETS, -(-total // BUCKET_ROWS))
    if n <= 1:
        return df.withColumn(name, F.lit(0)), 1
    cuts = df.agg(F.percentile_approx(column, [k / n for k in range(1, n)], 10 * n).alias("c")).first()["c"]
    from pyspark.ml.feature import Bucketizer

    splits = [float("-inf"), *sorted({float(c) for c in cuts}), float("inf")]
    out = Bucketizer(splits=splits, inputCol="_bx", outputCol="_bd").transform(df.withColumn("_bx", F.col(column).cast("double")))
    return out.withColumn(name, F.col("_bd").cast("int")).drop("_bx", "_bd"), len(splits) - 1


def split_exact(df: DataFrame, fraction: float = 0.9, seed: int = 0, key: str = "tile_id") -> tuple[DataFrame, DataFrame]:
    """Exact random split: the first ``int(n * fraction)`` rows of a seeded order, and the rest."""
    total = df.count()
    cut = int(total * fraction)
    rows = numbered(
        df.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key))), "_h", key, name="_r"
    ).drop("_h")
    return rows.filter(F.col("_r") < cut).drop("_r"), rows.filter(F.col("_r") >= cut).drop("_r")


def random_points(df: DataFrame, n: int, seed: int = 0, replace: bool = True, key: str = "tile_id") -> DataFrame:
    """``n`` rows at seeded random positions; with replacement a row may come more than once."""
    total = df.count()
    rng = random.Random(seed)
    if replace:
        drawn = [rng.randrange(total) for _ in range(n)] if total else []
    else:
        drawn = rng.sample(range(total), min(n, total))
    wanted = df.sparkSession.createDataFrame(list(enumerate(drawn)), "draw int, _r long")
    return numbered(df, key, name="_r").join(broadcast_if_small(wanted), "_r").drop("_r")


def rank_to_tile(df: DataFrame, tile_id: int, k: int = 50, vector: str = "embedding", key: str = "tile_id") -> DataFrame:
    """The ``k`` tiles nearest to one tile (itself included), nearest first."""
    from tilequery.functions.vectors import distance, vector_literal

    rows = bounded_rows(df.filter(F.col(key) == tile_id).select(vector), 1, f"tile {tile_id}")
    if not rows:
        raise ValueError(f"tile {tile_id} not found")
    d = distance(vector, vector_literal(rows[0][0]))
    return df.withColumn("dist", d).orderBy("dist", key).limit(k)


def top_per_group(df: DataFrame, by: list[str], order: list[Column | str], n: int, salts: int = 32, name: str = "rank") -> DataFrame:
    """First ``n`` rows of each group, ranked from 1.

    Small ``n`` is cut before the shuffle by Spark's group-limit rule; a large
    ``n`` is ranked in salted parts first, so that no task sorts a hot group whole.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    if n <= 1000:
        return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if c not in by]), F.lit(salts))
    part = Window.partitionBy(*by, "_salt").orderBy(*order)
    cut = df.withColumn("_salt", salt).withColumn(name, F.row_number().over(part)).filter(F.col(name) <= n)
    return cut.drop("_salt", name).withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def union_types(*dfs: DataFrame) -> DataFrame:
    """Tables of several tile types as one; they carry a ``tile_type`` column."""
    return reduce(DataFrame.unionByName, [require(d, "tile_type") for d in dfs])


def union_scenes(*dfs: DataFrame) -> DataFrame:
    """Tables of several scenes as one; columns a scene lacks become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [require(d, "scene_id") for d in dfs])


def missing_files(listing: DataFrame, cache: DataFrame, key: str = "filepath") -> DataFrame:
    """Listed files a cache does not know."""
    return listing.join(cache.select(key), key, "left_anti")


def has_all_types(df: DataFrame, types: tuple[str, ...] = TILE_TYPES) -> bool:
    """Whether exactly the given tile types occur."""
    found = {r[0] for r in bounded_rows(df.select("tile_type").distinct(), 100, "tile types")}
    return found == set(types)


def pending(scenes: DataFrame, done: DataFrame, key: str = "scene_id") -> DataFrame:
    """Scenes without stored results yet."""
    return scenes.join(done.select(key).distinct(), key, "left_anti")


def with_images(ids: DataFrame, images: DataFrame, key: str = "tile_id") -> DataFrame:
    """Chosen tiles with their pictures; the (few) ids go to the images, not the reverse."""
    return images.join(broadcast_if_small(ids), key)


def with_hue(df: DataFrame, labels: DataFrame, key: str = "tile_id", label: str = "hue") -> DataFrame:
    """Per-tile label and its palette position (rank of the label, from 0); both NULL for tiles without a label."""
    palette = palette_of(labels, label)
    return df.join(labels.select(key, label), key, "left").join(palette, label, "left")


def palette_of(labels: DataFrame, label: str) -> DataFrame:
    """Distinct labels with their position in sort order, from 0."""
    rows = numbered(labels.select(label).filter(F.col(label).isNotNull()).distinct(), label, name="_r")
    return inline_if_small(rows.select(label, F.col("_r").cast("int").alias("palette_pos")))
