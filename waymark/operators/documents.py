"""Documents of any shape compared path by path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.sources.scratch import settle


def flattened(docs: DataFrame, column: str) -> DataFrame:
    """id, path, parent, kind, value for each value of each JSON document (id, column: text), containers too: path is a JSON
    pointer, '' for the whole; kind is object, array, string, integer, number, boolean or null; value is the text of a
    plain value. Text that is no JSON has no rows. Each round takes apart one level of all documents as VARIANT, so there
    are as many rounds as levels; a large document is many rows."""
    spark = docs.sparkSession
    level = docs.select("id", F.lit("").alias("path"), F.lit(None).cast("string").alias("parent"), F.try_parse_json(column).alias("v")).filter("v IS NOT NULL")
    done = None
    while True:
        schema = F.schema_of_variant("v")
        kind = (
            F.when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "array").when(schema == "STRING", "string").when(schema == "BIGINT", "integer")
            .when(schema == "BOOLEAN", "boolean").when(schema == "VOID", "null").otherwise("number")
        )
        level = settle(level.select("id", "path", "parent", kind.alias("kind"), F.to_json("v").alias("text")), "level")
        part = level.select("id", "path", "parent", "kind", F.when(~F.col("kind").isin("object", "array"), F.col("text")).alias("value"))
        done = part if done is None else done.unionByName(part)
        inner = level.filter("kind IN ('object', 'array') AND text NOT IN ('{}', '[]')")
        if inner.isEmpty():
            return done
        opened = spark.sql("SELECT d.id, d.path AS parent, d.path || '/' || coalesce(e.key, CAST(e.pos AS STRING)) AS path, e.value AS v FROM {d} d, LATERAL variant_explode(parse_json(d.text)) e", d=inner)
        level = opened.select("id", "path", "parent", "v")


def document_diff(left: DataFrame, right: DataFrame, column: str = "doc") -> DataFrame:
    """id, path, change, old, new: how documents (id, column: JSON text) differ: added, removed, changed, retyped (a whole
    number that is now a number with a fraction part, or the reverse) and type_changed. A subtree that is new or gone, or
    whose kind changed, is told once, at its top. Documents of one side only are added or removed as a whole."""
    sides = [settle(flattened(d, column), "flat") for d in (left, right)]
    old, new = (d.select("id", "path", *[F.col(c).alias(f"{s}_{c}") for c in ("parent", "kind", "value")]) for s, d in zip(("old", "new"), sides, strict=True))
    both = settle(old.join(new, ["id", "path"], "full").withColumn("parent", F.coalesce("old_parent", "new_parent")), "both")
    numbers = lambda c: F.col(c).isin("integer", "number")
    change = (
        F.when(F.col("old_kind").isNull(), "added").when(F.col("new_kind").isNull(), "removed").when((F.col("old_kind") != F.col("new_kind")) & numbers("old_kind") & numbers("new_kind"), "retyped")
        .when(F.col("old_kind") != F.col("new_kind"), "type_changed").when(~F.col("old_value").eqNullSafe(F.col("new_value")), "changed")
    )
    told = both.withColumn("change", change).filter("change IS NOT NULL")
    alike = both.filter("old_kind = new_kind AND old_kind IN ('object', 'array')").select("id", F.col("path").alias("parent"))
    rows = told.filter("parent IS NULL").unionByName(told.filter("parent IS NOT NULL").join(alike, ["id", "parent"], "left_semi").select(*told.columns))
    brief = lambda s: F.coalesce(f"{s}_value", f"{s}_kind")
    return rows.select("id", "path", "change", brief("old").alias("old"), brief("new").alias("new"))
