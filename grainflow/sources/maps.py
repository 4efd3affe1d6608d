"""Readers of orientation maps: whitespace-separated text, with a point in every line.

Lines that are blank, start with # or hold something other than numbers are skipped. Column numbers count from 1.
The result is points(map_id, point_id, phi1, phi, phi2, x, y, phase); angles are in radians.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainflow.operators.components import checkpointed
from grainflow.operators.quantiles import quantile

NUMBER = r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?"


def _numeric_lines(spark: SparkSession, path: str) -> DataFrame:
    """(map_id, part): the numbers of each data line; the file's name stands for the map, or its folder's if the file is one of a table's parts (part-...)."""
    names = F.split(F.input_file_name(), "/")
    own = F.element_at(names, -1)
    lines = spark.read.text(path).select(F.when(own.startswith("part-"), F.element_at(names, -2)).otherwise(own).alias("map_id"), F.trim(F.translate("value", "\t,", "  ")).alias("line"))
    return lines.where(F.col("line").rlike(rf"^{NUMBER}(\s+{NUMBER})*$")).select("map_id", F.split("line", r"\s+").alias("part"))


def _point(euler: int, xy: int, phase: int) -> list[Column]:
    number = lambda i: F.element_at("part", i).cast("double")
    return [number(euler).alias("phi1"), number(euler + 1).alias("phi"), number(euler + 2).alias("phi2"), number(xy).alias("x"), number(xy + 1).alias("y"), number(phase).cast("int").alias("phase")]


def read_ang(spark: SparkSession, path: str, euler: int = 1, xy: int = 4, phase: int = 6) -> DataFrame:
    """Points of .ang files: only the six columns asked for are kept."""
    return with_ids(_numeric_lines(spark, path).where(F.size("part") >= max(euler + 2, xy + 1, phase)).select("map_id", *_point(euler, xy, phase)))


def read_plain(spark: SparkSession, path: str, euler: int = 1, xy: int = 4, phase: int = 6) -> DataFrame:
    """Points of plain tables (.txt, .csv), whose phases may start from 0 and whose y points down."""
    points = read_ang(spark, path, euler, xy, phase)
    ends = points.groupBy("map_id").agg(F.max("y").alias("top"), F.min("phase").alias("least"))
    joined = points.join(ends, "map_id")  # one row for each map
    return joined.withColumn("y", F.col("top") - F.col("y")).withColumn("phase", F.col("phase") + F.when(F.col("least") == 0, 1).otherwise(0)).drop("top", "least")


def read_ctf(spark: SparkSession, path: str) -> DataFrame:
    """Points of .ctf files (phase, x, y, bands, error, three angles in degrees); lines of phase 0 are unindexed and left out."""
    rows = _numeric_lines(spark, path).where(F.size("part") >= 8).select("map_id", *_point(6, 2, 1)).where(F.col("phase") > 0)
    return with_ids(rows.select("map_id", *(F.radians(a).alias(a) for a in ("phi1", "phi", "phi2")), "x", "y", "phase"))


def with_ids(points: DataFrame) -> DataFrame:
    """Add point_id, a hash of the place: the same in every run, whatever the partitions."""
    return points.withColumn("point_id", F.xxhash64("map_id", "x", "y"))


def from_colours(pixels: DataFrame, rows: str = "row", columns: str = "col", colour: str = "colour") -> DataFrame:
    """A map from an image's pixels: colours become phases in the order in which they first appear, row by row.

    The first row and column are repeated after the last ones, so that the map is periodic; angles are 0.
    """
    first = pixels.groupBy(colour).agg(F.min(F.struct(rows, columns)).alias("first"))
    from pyspark.sql import Window

    ranked = first.select(colour, F.row_number().over(Window.orderBy("first")).alias("phase"))  # one row for each colour
    size = pixels.agg((F.max(rows) + 1).alias("height"), (F.max(columns) + 1).alias("width"))
    both = pixels.join(F.broadcast(size)).join(ranked, colour)
    wrap = lambda c, n: F.when(F.col(c) == 0, F.array(F.lit(0), F.col(n))).otherwise(F.array(F.col(c)))
    out = both.withColumn("y", F.explode(wrap(rows, "height"))).withColumn("x", F.explode(wrap(columns, "width")))
    return out.select(F.lit(0.0).alias("phi1"), F.lit(0.0).alias("phi"), F.lit(0.0).alias("phi2"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "phase")


def random_two_phase(grid: DataFrame, centres: DataFrame, size: float, fraction: float, error: float = 1e-9) -> DataFrame:
    """(x, y, phase) of places (x, y) on a periodic square of side `size`: a sum of Gaussian bumps around centres (cx, cy) and their periodic
    images, cut at the level that gives phase 2 the `fraction` of the places.

    A bump is left out where it is below `error` over the number of centres, so that no sum is off by more than `error`. What is left of it
    fits a bucket and its neighbours round the torus: a place meets the centres of nine buckets at most, some hundreds, however large the map.
    """
    n = max(1, centres.count())
    width = size / (2.0 * n**0.5)
    reach = width * math.sqrt(2 * math.log(max(n / error, math.e)))
    buckets = max(1, int(size / reach))
    own = lambda c: F.pmod(F.floor(F.col(c) / (size / buckets)), F.lit(buckets))
    around = lambda c: F.explode(F.array_distinct(F.array(*(F.pmod(own(c) + k, F.lit(buckets)) for k in (-1, 0, 1)))))
    asked = grid.select("x", "y").withColumn("bx", around("x")).withColumn("by", around("y"))
    placed = centres.select("cx", "cy", own("cx").alias("bx"), own("cy").alias("by"))
    near = lambda a, b: F.least(F.abs(F.col(a) - F.col(b)), F.lit(float(size)) - F.abs(F.col(a) - F.col(b)))
    far2 = near("x", "cx") * near("x", "cx") + near("y", "cy") * near("y", "cy")
    bump = F.when(far2 <= reach * reach, F.exp(-far2 / (2 * width * width))).otherwise(0.0)
    # A bucket's bumps are added up before the nine meet; places that no bump reaches have level 0.
    field = asked.join(placed, ["bx", "by"], "left").groupBy("x", "y").agg(F.coalesce(F.sum(bump), F.lit(0.0)).alias("level"))
    field = checkpointed(field)
    cut = quantile(field, "level", 1 - fraction)
    return field.select("x", "y", F.when(F.col("level") > cut, 2).otherwise(1).alias("phase"))


def image_pixels(images: DataFrame) -> DataFrame:
    """(origin, row, col, colour) of images as Spark's image source gives them: the colour is the pixel's bytes in hexadecimal, blue, green, red and alpha as far as there are.

    An image is cut into its rows by position, and these into pixels, so that no row carries the image. Images that couldn't be read (height below 1) have no pixels.
    """
    i = lambda c: F.col(f"image.{c}")
    whole = images.select(i("origin").alias("origin"), i("height").alias("h"), i("width").alias("w"), i("nChannels").alias("n"), i("data").alias("data")).where("h > 0 AND w > 0 AND n > 0")
    lines = F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda k: F.substring(F.col("data"), k * F.col("w") * F.col("n") + 1, F.col("w") * F.col("n")))
    rows = whole.select("origin", "w", "n", F.posexplode(lines).alias("row", "line"))
    pixels = F.transform(F.sequence(F.lit(0), F.col("w") - 1), lambda k: F.hex(F.substring(F.col("line"), k * F.col("n") + 1, F.col("n"))))
    return rows.select("origin", "row", F.posexplode(pixels).alias("col", "colour"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """The pixels of the images below `path` (PNG, JPEG, BMP, GIF), decoded by Spark; broken files are left out."""
    return image_pixels(spark.read.format("image").option("dropInvalid", True).load(path))
