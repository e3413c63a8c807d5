"""Quantities in common units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evisift.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from evisift.operators.units import convert_quantities

    return convert_quantities(table(spark, d, "extraction_values"), table(spark, d, "form_fields"), table(spark, d, "unit_registry"))


QUERIES = {"p3_found": p3_found}
ORACLE: dict[str, str] = {}
