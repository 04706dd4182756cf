"""Tile geometry: capped image sizes, tile plans, blank tiles, and boxes mapped from tiles to images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsheaf.settings import DEFAULTS, Settings


def capped_sizes(images: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds new_width, new_height, scale: within the longest edge and pixel limits, the aspect ratio kept."""
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    edge, most = settings.max_image_edge, settings.max_image_pixels
    scale = F.when((w <= 0) | (h <= 0), 1.0).otherwise(F.least(F.lit(1.0), F.lit(float(edge)) / F.greatest(w, h), F.sqrt(F.lit(float(most)) / (w * h))))
    sized = images.withColumn("scale", scale)
    first = lambda c: F.greatest(F.lit(1), F.floor(F.col(c) * F.col("scale") + 1e-6).cast("long"))
    start = F.struct(first("width").alias("w"), first("height").alias("h"))

    def shrink(acc: Column, _: Column) -> Column:
        over = (acc["w"] * acc["h"] > most) | (F.greatest(acc["w"], acc["h"]) > edge)
        wide = acc["w"] >= acc["h"]
        return F.struct((acc["w"] - F.when(over & wide, 1).otherwise(0)).alias("w"), (acc["h"] - F.when(over & ~wide, 1).otherwise(0)).alias("h"))

    # The floor leaves at most a rounding step over a limit, so a few steps are enough.
    end = F.aggregate(F.sequence(F.lit(1), F.lit(8)), start, shrink)
    fits = F.when(F.col("scale") >= 1.0, F.struct(F.col("width").cast("long").alias("w"), F.col("height").cast("long").alias("h"))).otherwise(end)
    return sized.withColumn("capped", fits).select(*images.columns, F.col("capped.w").alias("new_width"), F.col("capped.h").alias("new_height"), "scale")


def _count(length: Column, size: int, overlap: int) -> Column:
    return F.when(length <= size, 1).otherwise(F.ceil((length - overlap) / F.lit(size - overlap))).cast("long")


def _starts(length: Column, count: Column, overlap: int) -> Column:
    """array<struct<a, b>> of the spans of one axis."""
    span = F.when(count == 1, length).otherwise(F.ceil((length + (count - 1) * overlap) / count)).cast("long")
    step = F.when(count > 1, (length - span) / (count - 1)).otherwise(0.0)
    start = lambda i: F.rint(i * step).cast("long")
    return F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), lambda i: F.struct(start(i).alias("a"), (start(i) + span).alias("b")))


def plan_tiles(images: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row per tile of each image that needs tiles: row, col, pixel edges on the planned size and the source box.

    The planned size is the image's times the first power of 0.95 that needs at most max_tiles tiles. Smaller sizes never
    need more tiles, so that power is found by halving the list of powers.
    """
    size = settings.tile_size
    overlap = min(round(size * settings.tile_overlap), size // 2)
    large = images.filter((F.greatest("width", "height") > settings.tile_min_source_edge) & (F.greatest("width", "height") > size))
    # A table of sizes is small, so it is read by few tasks; what it grows to is dealt to as many as a shuffle has.
    large = large.repartition(int(images.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    scales, s = [], 1.0
    while s > 1e-3:
        scales.append(s)
        s *= 0.95
    side = lambda c, s: F.greatest(F.lit(1), F.rint(F.col(c) * s)).cast("long")

    def fits(s: Column) -> Column:
        w, h = side("width", s), side("height", s)
        return (_count(w, size, overlap) * _count(h, size, overlap) <= settings.max_tiles) | (F.greatest(w, h) <= size)

    powers = F.array(*map(F.lit, scales))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        found = (acc["low"] < acc["high"]) & fits(F.get(powers, middle))
        return F.struct(F.when(found | (acc["low"] >= acc["high"]), acc["low"]).otherwise(middle + 1).alias("low"), F.when(found, middle).otherwise(acc["high"]).alias("high"))

    whole = F.struct(F.lit(0).alias("low"), F.lit(len(scales)).alias("high"))
    first = F.aggregate(F.sequence(F.lit(1), F.lit(len(scales).bit_length())), whole, halve, lambda acc: acc["low"])
    planned = large.withColumn("scale", F.get(powers, first))
    planned = planned.withColumns({"plan_width": side("width", F.col("scale")), "plan_height": side("height", F.col("scale"))})
    planned = planned.withColumns({"cols": _count(F.col("plan_width"), size, overlap), "rows": _count(F.col("plan_height"), size, overlap)})
    rows = planned.select("*", F.posexplode(_starts(F.col("plan_height"), F.col("rows"), overlap)).alias("r", "v"))
    tiles = rows.select("*", F.posexplode(_starts(F.col("plan_width"), F.col("cols"), overlap)).alias("c", "u"))
    part = lambda a, b: F.round(F.col(a) / F.col(b), 9)
    return tiles.select(
        *images.columns, "scale", "plan_width", "plan_height", "rows", "cols", (F.col("r") + 1).alias("row"), (F.col("c") + 1).alias("col"),
        F.col("u.a").alias("left"), F.col("v.a").alias("top"), F.col("u.b").alias("right"), F.col("v.b").alias("bottom"),
        part("u.a", "plan_width").alias("x0"), part("v.a", "plan_height").alias("y0"), part("u.b", "plan_width").alias("x1"), part("v.b", "plan_height").alias("y1"),
    )


def blank_tiles(histograms: DataFrame, keys: list[str], settings: Settings = DEFAULTS) -> DataFrame:
    """Per tile: blank. histograms: keys, bin, count. The most frequent brightness (the lowest on ties) is background."""
    mode = F.max(F.struct("count", (-F.col("bin")).alias("b")))
    tiles = histograms.groupBy(*keys).agg(F.sum("count").alias("total"), (-mode["b"]).alias("background"))
    near = F.abs(F.col("bin") - F.col("background")) <= settings.blank_tolerance
    different = histograms.join(tiles, keys).groupBy(*keys).agg(F.max("total").alias("total"), F.max("background").alias("background"), F.sum(F.when(~near, F.col("count")).otherwise(0)).alias("different"))
    return different.withColumn("blank", (F.col("total") <= 0) | (F.col("different") <= F.col("total") * settings.blank_pixel_ratio))


def tile_grid_summary(tiles: DataFrame, key: str) -> DataFrame:
    """Per image: rows, cols, sent and blank tiles, and whether it stays tiled (some tile has content)."""
    return tiles.groupBy(key).agg(
        F.max("row").cast("long").alias("rows"), F.max("col").cast("long").alias("cols"), F.sum((~F.col("blank")).cast("long")).alias("sent"), F.sum(F.col("blank").cast("long")).alias("blank_tiles"),
        F.max(~F.col("blank")).alias("tiled"),
    )


def map_boxes_to_source(boxes: DataFrame, tiles: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes in fractions of their tile as fractions of the whole image. tiles: keys, x0, y0, x1, y1."""
    both = boxes.join(tiles.select(*keys, "x0", "y0", "x1", "y1"), keys)
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    new = {"x": F.col("x0") + F.col("x") * wide, "y": F.col("y0") + F.col("y") * high, "w": F.col("w") * wide, "h": F.col("h") * high}
    return both.select(*[new.get(c, F.col(c)).alias(c) for c in boxes.columns])

