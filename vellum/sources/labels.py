"""Readers and writers of label formats. Malformed lines are dropped, never fatal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OBJECTS = "array<struct<points:array<array<double>>,score:double>>"


def split_lines(lines: DataFrame, least_points: int = 3, least_score: float | None = None) -> DataFrame:
    """lines(value): `path TAB JSON list` to (path, polygons). Blank lines, lines without a tab
    and JSON that is no list are dropped; a missing score is 1; polygons need least_points."""
    parts = F.split("value", "\t", 2)
    rows = lines.where("trim(value) <> ''").select(F.trim(parts[0]).alias("path"), F.from_json(F.get(parts, F.lit(1)), OBJECTS).alias("objects")).where("objects is not null")
    kept = F.filter("objects", lambda o: F.size(F.coalesce(o["points"], F.array())) >= least_points)
    if least_score is not None:
        kept = F.filter(kept, lambda o: F.coalesce(o["score"], F.lit(1.0)) >= least_score)
    return rows.select("path", F.transform(kept, lambda o: o["points"]).alias("polygons"))


def read_labels(spark: SparkSession, path: str, **options) -> DataFrame:
    return split_lines(spark.read.text(path), **options)


def read_split(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, ordinal) of split files, one path per line: the first occurrence of each, in order
    of files and lines."""
    parts = None
    for i, p in enumerate(paths):
        lines = spark.read.text(p, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "path"))
        rows = lines.select(F.trim("path").alias("path"), F.struct(F.lit(i).alias("file"), "n").alias("ordinal")).where("path <> ''")
        parts = rows if parts is None else parts.unionAll(rows)
    return parts.groupBy("path").agg(F.min("ordinal").alias("ordinal"))


def yolo_polygons(lines: DataFrame, width: Column, height: Column) -> DataFrame:
    """lines(value, ...): `class x1 y1 x2 y2 ...` with shares of the picture to points in pixels,
    clipped and truncated. Lines of fewer than 7 tokens or an odd number of coordinates go."""
    tokens = lines.withColumn("t", F.split(F.trim("value"), " +")).where("size(t) >= 7 and size(t) % 2 = 1")
    at = lambda i, size: F.least(size - 1, F.greatest(F.lit(0.0), F.get("t", i).cast("double") * size)).cast("int")
    points = F.transform(F.sequence(F.lit(0), ((F.size("t") - 1) / 2 - 1).cast("int")), lambda k: F.struct(at(2 * k + 1, width).alias("x"), at(2 * k + 2, height).alias("y")))
    return tokens.withColumns({"class": F.get("t", F.lit(0)).cast("int"), "points": points}).drop("t")


def is_valid_yolo(lines: str = "lines") -> Column:
    """Whether any line of an array has 7 tokens or more and an even number of coordinates."""
    return F.exists(lines, lambda v: (F.size(F.split(F.trim(v), " +")) >= 7) & (F.size(F.split(F.trim(v), " +")) % 2 == 1))


def yolo_line(cls: Column, points: Column, width: Column, height: Column) -> Column:
    """`class x y ...` with shares of the picture to six places, clipped to [0, 1], ties to even."""
    share = lambda v, size: F.format_string("%.6f", F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), v / size)), 6))
    return F.concat_ws(" ", cls.cast("string"), F.array_join(F.transform(points, lambda p: F.concat_ws(" ", share(p["x"], width), share(p["y"], height))), " "))


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(images, annotations) of a COCO file."""
    root = spark.read.json(path, multiLine=True, schema=(
        "images array<struct<id:bigint,file_name:string,width:int,height:int>>, "
        "annotations array<struct<image_id:bigint,category_id:int,segmentation:array<array<double>>,attributes:struct<translation:string>>>"
    ))
    return root.select(F.inline("images")), root.select(F.posexplode("annotations").alias("ordinal", "a")).select("ordinal", "a.*")


def rings(annotations: DataFrame, categories: list[int] | None = None, first: bool = False) -> DataFrame:
    """(image_id, category_id, ordinal, points): rings of three points or more, of the given
    categories in their order; with `first`, an annotation's first ring only."""
    rows = annotations if categories is None else annotations.where(F.col("category_id").isin(categories))
    ring = F.slice("segmentation", 1, 1) if first else F.col("segmentation")
    pairs = lambda r: F.transform(F.sequence(F.lit(0), F.floor(F.size(r) / 2).cast("int") - 1), lambda k: F.struct(F.get(r, 2 * k).alias("x"), F.get(r, 2 * k + 1).alias("y")))
    out = rows.select("image_id", "category_id", "ordinal", F.posexplode(F.filter(ring, lambda r: F.size(r) >= 6)).alias("ring", "r"))
    return out.select("image_id", "category_id", "ordinal", "ring", pairs(F.col("r")).alias("points"))


def clipped_box(points: Column, width: Column, height: Column, pad: int = 12, least: int = 8) -> Column:
    """struct(x0, y0, x1, y1) around points, padded and clipped; null where a side is under
    `least` or nothing is left."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    w, h = F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys)
    box = F.struct(
        F.greatest(F.lit(0.0), F.array_min(xs) - pad).alias("x0"), F.greatest(F.lit(0.0), F.array_min(ys) - pad).alias("y0"),
        F.least(width.cast("double"), F.array_max(xs) + pad).alias("x1"), F.least(height.cast("double"), F.array_max(ys) + pad).alias("y1"),
    )
    return F.when((w >= least) & (h >= least) & (box["x1"] > box["x0"]) & (box["y1"] > box["y0"]), box)


def safe_name(path: Column) -> Column:
    """A file name for a path: separators and other odd characters become underscores."""
    return F.regexp_replace(path, r"[^0-9A-Za-zА-Яа-яЁё._-]+", "_")


def page_name(index: Column, path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))
    return F.concat(F.format_string("page_%06d", index), F.when(suffix.isin(".jpg", ".jpeg", ".png", ".bmp", ".webp"), suffix).otherwise(".jpg"))


def candidates(path: Column) -> Column:
    """Names under which a labelled file may be stored, best first: as it is, without a doubled
    suffix, the bare name."""
    doubled = F.regexp_replace(path, r"(?i)(\.(?:png|jpe?g|bmp))\.(?:png|jpe?g|bmp)$", "$1")
    name = lambda p: F.element_at(F.split(p, "/"), -1)
    return F.array_distinct(F.array(path, doubled, name(path), name(doubled)))


def resolved(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted(path), files(file): each path with the best candidate that exists, or with any file
    of the same stem; null if there is none."""
    stem = lambda p: F.regexp_replace(F.element_at(F.split(p, "/"), -1), r"\..*$", "")
    tried = wanted.select("path", F.posexplode(candidates(F.col("path"))).alias("rank", "file")).join(files, "file")
    alike = wanted.withColumn("stem", stem(F.col("path"))).join(files.withColumn("stem", stem(F.col("file"))), "stem").select("path", F.lit(9).alias("rank"), "file")
    best = tried.select("path", "rank", "file").unionAll(alike).groupBy("path").agg(F.min_by("file", F.struct("rank", "file")).alias("file"))
    return wanted.join(best, "path", "left")


def page_images(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """(path, height, width, channels, data) of a folder of pictures, read by Spark's own source."""
    return spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", pattern).load(path).select(F.col("image.origin").alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def append_rows(rows: DataFrame, path: str) -> None:
    """One JSON object per line, appended: a run's log."""
    rows.write.mode("append").json(path)
