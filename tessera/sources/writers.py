"""Sinks: idempotent inserts and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def new_rows(offered: DataFrame, target: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """The offered rows whose key the target lacks, one for each key (the first by `order`); keys compare null-safe."""
    if order:
        w = Window.partitionBy(*keys).orderBy(*order)
        offered = offered.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    else:
        offered = offered.dropDuplicates(keys)
    have = target.select(*(F.col(k).alias(f"_{k}") for k in keys))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return offered.join(have, condition, "left_anti")


def append_new(offered: DataFrame, path: str, keys: list[str]) -> tuple[int, int]:
    """Append what a Parquet table lacks; returns rows offered and rows written.

    Running it again writes nothing: a retry after a lost driver is safe.
    """
    spark = offered.sparkSession
    target = spark.read.schema(offered.schema).parquet(path)
    before = target.count()
    new_rows(offered, target, keys).write.mode("append").parquet(path)
    return offered.count(), spark.read.schema(offered.schema).parquet(path).count() - before


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, quote='"', escape='"')


def geojson_features(df: DataFrame, id_: str, ring: str, properties: list[str]) -> DataFrame:
    """One JSON feature per line from rings of (x, y); open rings are closed."""
    points = F.transform(ring, lambda p: F.array(p["x"], p["y"]))
    closed = F.when(F.element_at(points, 1) == F.element_at(points, -1), points).otherwise(F.concat(points, F.slice(points, 1, 1)))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(closed).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.col(id_).alias("id"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))
    return df.select(F.to_json(feature).alias("value"))


def coco_annotations(df: DataFrame, image: str, category: str, ring: str, order: list[str], scale: Column | float = 1.0) -> DataFrame:
    """Annotation rows: id within the image, image, category, box, flat segmentation relative to the box corner, area."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    x0, y0, x1, y1 = F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)
    scale = scale if isinstance(scale, Column) else F.lit(float(scale))
    flat = F.flatten(F.transform(ring, lambda p: F.array((p["x"] - x0) * scale, (p["y"] - y0) * scale)))
    number = F.row_number().over(Window.partitionBy(image).orderBy(*order))
    box = F.array((x1 - x0) * scale, (y1 - y0) * scale)
    return df.select(number.alias("annotation"), image, category, x0.alias("x"), y0.alias("y"), box.alias("size"), flat.alias("segmentation"), ((x1 - x0) * (y1 - y0) * scale * scale).alias("box_area"))
