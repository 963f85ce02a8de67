"""Readers with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GEOJSON = "type string, features array<struct<type string, id string, properties map<string,string>, geometry struct<type string, coordinates string>>>"


def table(spark: SparkSession, folder: str, name: str, schema: str | None = None) -> DataFrame:
    """A Parquet table of a folder; with a schema nothing is inferred."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{folder}/{name}.parquet")


def partitioned_jdbc(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """A database table read in key ranges at once; needs the database's driver on the class path."""
    options = {"url": url, "dbtable": name, "partitionColumn": key, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(**options).load()


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the lines that aren't JSON of this schema (such as a half-written last one)."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    bad = spark.read.text(path).withColumn("row", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    return rows.where("_corrupt_record IS NULL").drop("_corrupt_record"), bad.where("row IS NULL OR row._bad IS NOT NULL").select("value")


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Comma-separated with a header, quotes doubled inside quotes, line breaks allowed in them."""
    return spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', multiLine=True)


def xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("rowTag", row_tag).format("xml").load(path)


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """One row per feature: id, properties, geometry type and its coordinates as JSON."""
    files = spark.read.schema(GEOJSON).json(path, multiLine=True)
    feature = files.select(F.explode("features").alias("f"))
    return feature.select("f.id", "f.properties", F.col("f.geometry.type").alias("geometry"), F.col("f.geometry.coordinates").alias("coordinates"))


def osm_tag(tags: str, name: str) -> F.Column:
    """One value of a `"key"=>"value"` tag string; null without it."""
    return F.nullif(F.regexp_extract(tags, f'"{name}"=>"([^"]*)"', 1), F.lit(""))


def key_values(column: str) -> F.Column:
    """A map from 'k=v; k=v' notes."""
    return F.str_to_map(F.col(column), F.lit("; ?"), F.lit("="))
