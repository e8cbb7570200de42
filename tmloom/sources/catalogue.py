"""The catalogue of models as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

FIELDS = "id string, name string, provider string, usage string, context_window long, input_cost_per_m double, output_cost_per_m double"


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """One row for each model of a JSON file with a list ``models``, in order; ``is_default`` marks the first."""
    df = spark.read.schema(f"models array<struct<{FIELDS.replace(' ', ':').replace(',:', ',')}>>").json(path, multiLine=True)
    return df.select(F.posexplode("models").alias("pos", "m")).select("pos", "m.*", (F.col("pos") == 0).alias("is_default"))


def selectable(models: DataFrame, hidden: str = "bg") -> DataFrame:
    """The models that a user may choose."""
    return models.filter(F.coalesce(F.col("usage") != hidden, F.lit(True)))


def default_model(models: DataFrame, preferred: str | None = None, part: str | None = None) -> str | None:
    """The preferred model if it may be chosen, else the first whose id holds ``part``, else the first; null if there is none.

    The catalogue is a short list.
    """
    ids = [r.id for r in selectable(models).orderBy("pos").collect()]
    return next((i for i in ids if i == preferred), None) or next((i for i in ids if part and part in i), None) or (ids[0] if ids else None)
