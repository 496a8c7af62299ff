"""Detections: scales, clamping, measures of a face, and overlap suppression."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions.vectors import bound

#: The least confidence, the overlap that suppresses, the first
#: scale's longest side.
CONFIDENCE, OVERLAP, FIRST_SIDE = 0.5, 0.4, 640


def scales(width: Column, height: Column, max_side: int) -> Column:
    """The different scales at which an image is searched; never above 1."""
    longest = F.greatest(width, height).cast("double")
    return F.array_distinct(F.array(*[F.least(F.lit(1.0), F.lit(float(s)) / longest) for s in (min(FIRST_SIDE, max_side), max_side)]))


def clamp(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """struct(x, y, w, h) inside the image."""
    left, top = F.greatest(F.lit(0.0), x1), F.greatest(F.lit(0.0), y1)
    right, bottom = F.least(width.cast("double"), x2), F.least(height.cast("double"), y2)
    return F.struct(left.alias("x"), top.alias("y"), (right - left).alias("w"), (bottom - top).alias("h"))


def measures(box: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """The face's shorter side and its share of the image."""
    return F.least(box["w"], box["h"]), box["w"] * box["h"] / (width * height)


def sharpness(gray: Column, side: int) -> Column:
    """struct(blur, brightness) of a square of gray values, line by line: the variance of its Laplacian, and its mean.

    Beyond an edge the values are mirrored at the outermost line, which is not repeated.
    """

    def near(v: Column, line: Column, column: Column) -> Column:
        inside = lambda k: F.abs(F.lit(side - 1) - F.abs(F.lit(side - 1) - F.abs(k)))
        return F.get(v, (inside(line) * side + inside(column)).cast("int"))

    def edge(v: Column, i: Column) -> Column:
        line, column = F.floor(i / side), i % side
        around = near(v, line - 1, column) + near(v, line + 1, column) + near(v, line, column - 1) + near(v, line, column + 1)
        return (around - 4 * F.get(v, i)).cast("double")

    def mean(v: Column) -> Column:
        return F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)

    def variance(v: Column) -> Column:
        return bound(F.struct(v.alias("v"), mean(v).alias("m")), lambda p: mean(F.transform(p["v"], lambda x: (x - p["m"]) * (x - p["m"]))))

    def both(v: Column) -> Column:
        edges = F.transform(v, lambda x, i: edge(v, i))
        return F.struct(bound(edges, variance).alias("blur"), mean(F.transform(v, lambda x: x.cast("double"))).alias("brightness"))

    return bound(gray, both)


def usable(box: Column, confidence: Column) -> Column:
    return (box["w"] > 0) & (box["h"] > 0) & (confidence >= CONFIDENCE)


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes with corners x1, y1, x2, y2."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    return w * h / (area(a) + area(b) - w * h)


def suppress(boxes: DataFrame, image: str = "image_id", threshold: float = OVERLAP) -> DataFrame:
    """The detections of each image that no kept, more confident one overlaps.

    ``boxes`` has the image, box_id, conf and the corners. An image's detections
    are folded natively in order of confidence; their number is the image's own.
    """
    fields = ["conf", "box_id", "x1", "y1", "x2", "y2"]
    rows = boxes.where(F.col("conf") >= CONFIDENCE)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("conf")).alias("order"), "box_id", "conf", "x1", "y1", "x2", "y2")))
    start = F.expr("cast(array() as array<struct<order:double,box_id:bigint,conf:double,x1:double,y1:double,x2:double,y2:double>>)")
    kept = F.aggregate("all", start, lambda k, b: F.when(F.exists(k, lambda o: overlap(o, b) >= threshold), k).otherwise(F.concat(k, F.array(b))))
    return rows.groupBy(image).agg(ordered.alias("all")).select(image, F.explode(kept).alias("b")).select(image, *[F.col(f"b.{f}").alias(f) for f in fields])
