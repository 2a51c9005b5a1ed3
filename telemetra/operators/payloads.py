"""JSON payloads without a declared schema, read as VARIANT."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

MALFORMED = "MALFORMED"


def typed_values(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """(``keep``, key, value_type, value): a row for each top-level key of each payload, with the value's type and text.

    A payload that is no object has one row without a key, one that does not parse a row of type ``MALFORMED`` with its text; a NULL
    payload and an empty object have none. The text is parsed once, in the scan's stage; nothing is shuffled. ``keep`` must not hold the new names.
    """
    d = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{column}`").alias("_text"), F.try_parse_json(F.col(f"`{column}`")).alias("_v")).filter("_text IS NOT NULL")
    is_object = F.schema_of_variant("_v").startswith("OBJECT")
    kept = [F.col(f"`{c}`") for c in keep]
    tvf = df.sparkSession.tvf
    objects = d.filter(F.col("_v").isNotNull() & is_object).lateralJoin(tvf.variant_explode(F.col("_v").outer()))
    each = objects.select(*kept, F.col("key"), F.schema_of_variant("value").alias("value_type"), F.try_variant_get("value", "$", "string").alias("value"))
    others = d.filter(F.col("_v").isNull() | ~is_object)
    lone = others.select(*kept, F.lit(None).cast("string").alias("key"), F.coalesce(F.schema_of_variant("_v"), F.lit(MALFORMED)).alias("value_type"),
                         F.when(F.col("_v").isNull(), F.col("_text")).otherwise(F.try_variant_get("_v", "$", "string")).alias("value"))
    return each.unionByName(lone)


def payload_schema(df: DataFrame, column: str) -> DataFrame:
    """One row: the schema that all payloads fit (an aggregate, combined map-side), their number and how many do not parse."""
    v = F.try_parse_json(F.col(f"`{column}`"))
    return df.agg(F.schema_of_variant_agg(v).alias("payload_schema"), F.count(F.col(f"`{column}`")).alias("n_payloads"),
                  F.count_if(F.col(f"`{column}`").isNotNull() & v.isNull()).alias("n_malformed"))
