"""Graph and track files: XML rows for nodes, edges and track points, and GeoJSON features as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_xml(rows: DataFrame, path: str, root: str, row: str) -> None:
    """Rows as XML elements named `row` below `root`, one file for each partition. Columns whose names begin with _ become attributes; nulls are left out."""
    rows.write.format("xml").option("rootTag", root).option("rowTag", row).save(path)


def read_xml(spark: SparkSession, path: str, row: str, schema: str) -> DataFrame:
    """The elements named `row` with the columns of the schema; what an element lacks is null."""
    return spark.read.format("xml").option("rowTag", row).schema(schema).load(path)


def point_feature(ident: Column, lon: Column, lat: Column, **properties: Column) -> Column:
    """A GeoJSON point feature as a struct."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    fields = F.struct(*[c.alias(n) for n, c in properties.items()])
    return F.struct(F.lit("Feature").alias("type"), ident.alias("id"), geometry.alias("geometry"), fields.alias("properties"))


def write_features(features: DataFrame, path: str) -> None:
    """One column of feature structs as JSON lines, one feature a line."""
    features.select(F.col(features.columns[0]).alias("f")).select("f.*").write.json(path)


def read_features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """id, lon, lat and the properties (a schema string) of point features; rows that aren't points have null coordinates."""
    schema = f"type string, id long, geometry struct<type:string,coordinates:array<double>>, properties struct<{properties}>"
    rows = spark.read.schema(schema).json(path)
    at = lambda k: F.when(F.col("geometry.type") == "Point", F.get("geometry.coordinates", F.lit(k)))
    return rows.select("id", at(0).alias("lon"), at(1).alias("lat"), "properties.*")
