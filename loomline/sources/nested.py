"""Nested JSON as rows of dotted paths, over Spark's variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.session import Scratch, scratch


def _kind(v: str) -> Column:
    """object, array, or scalar."""
    shown = F.schema_of_variant(v)
    return F.when(shown.startswith("OBJECT"), "object").when(shown.startswith("ARRAY"), "array").otherwise("scalar")


def flattened(df: DataFrame, ident: str, column: str) -> DataFrame:
    """(id, path, value) of every node of the JSON texts in a column: names and places joined by dots.

    A scalar gives its text, null for null; an object the names of its members, in order, with a space between; an array gives its length under `.length`. The outermost
    object has an empty path, and an outermost array the path `length`. Members are in the order of their names. Texts that are not JSON, and nulls, give no rows; of a name
    that comes twice in an object the text is not JSON. Levels are taken apart one per round, all texts at once, each round written, so nesting costs rounds and no recursion.
    """
    spark = df.sparkSession
    out, named = scratch(spark, "json"), F.when(F.col("path") == "", F.col("c.name")).otherwise(F.concat_ws(".", "path", "c.name"))
    level = df.select(F.col(ident).alias("id"), F.lit("").alias("path"), F.col(column).alias("text"))
    old = Scratch(spark)
    while True:
        new = Scratch(spark)
        level = new.written(level, "json-level").withColumn("v", F.try_parse_json("text")).where("v IS NOT NULL").withColumn("kind", _kind("v"))
        items, members = F.expr("cast(v AS array<variant>)"), F.expr("cast(v AS map<string, variant>)")
        length = F.when(F.col("path") == "", F.lit("length")).otherwise(F.concat("path", F.lit(".length")))
        scalar = level.where("kind = 'scalar'").select("id", "path", F.expr("cast(v AS string)").alias("value"))
        arrays = level.where("kind = 'array'").select("id", length.alias("path"), F.size(items).cast("string").alias("value"))
        objects = level.where("kind = 'object'").select("id", "path", F.array_join(F.array_sort(F.map_keys(members)), " ").alias("value"))
        scalar.unionByName(arrays).unionByName(objects).write.mode("append").parquet(out)
        within = level.where("kind = 'object'").select("id", "path", F.explode(F.transform(F.map_entries(members), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("v")))).alias("c"))
        placed = level.where("kind = 'array'").select("id", "path", F.explode(F.transform(items, lambda x, k: F.struct(k.cast("string").alias("name"), x.alias("v")))).alias("c"))
        deeper = within.unionByName(placed).select("id", named.alias("path"), F.to_json("c.v").alias("text"))
        old.drop()
        old = new
        if not level.where("kind <> 'scalar'").head(1):
            break
        level = deeper
    old.drop()
    return spark.read.schema(scalar.schema).parquet(out)
