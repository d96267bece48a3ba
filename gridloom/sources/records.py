"""Metric records as CSV and nested JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRIC_COLUMNS = ("station", "model", "rmse", "mae", "r2", "n_rows")


def upsert_metrics(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """All rows of the models in ``rows`` are replaced, so a re-run adds nothing."""
    models = rows.select("model").distinct()
    return existing.join(models, "model", "left_anti").select(*existing.columns).unionByName(rows, allowMissingColumns=True)


def upsert_in_place(rows: DataFrame, path: str) -> None:
    """Metrics kept at one path, a folder a model: only the folders of the models in ``rows`` are replaced, each when the job commits.

    A run that ends early leaves all models as they were; a repeated one changes nothing.
    """
    writer = rows.write.mode("overwrite").partitionBy("model").option("header", "true").option("partitionOverwriteMode", "dynamic")
    writer.csv(path)


def append_metrics(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """Plain append; running it twice keeps both copies."""
    return existing.unionByName(rows, allowMissingColumns=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(path)


def write_nested_json(df: DataFrame, key: str, fields: Sequence[str], path: str) -> None:
    """One JSON object ``{key: {field: value}}`` per line; structs and maps among the fields become nested objects."""
    document = F.create_map(F.col(key), F.struct(*fields))
    df.select(F.to_json(document, {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def read_nested_json(spark: SparkSession, path: str, key: str = "station", whole_document: bool = False) -> DataFrame:
    """``{key: {metric: value}}`` of any depth as rows of key, metric, value, text.

    ``metric`` is the path below the key, joined by dots; numbers are in ``value``, everything else but nested objects is
    in ``text``. One pass is made per level of nesting. A text that is no JSON raises, and so does one that is no object.
    """
    lines = spark.read.text(path, wholetext=whole_document).where(F.trim("value") != "")
    document = F.parse_json("value")
    is_object = F.schema_of_variant(document).startswith("OBJECT")
    checked = F.when(is_object, document).otherwise(F.raise_error(F.lit("a metric document must be an object")).cast("variant"))
    level = _open(spark, lines.select(checked.alias("_v"))).select(F.col("_key").alias(key), F.lit(None).cast("string").alias("metric"), "_v")
    done = None
    while True:
        nested = F.schema_of_variant("_v").startswith("OBJECT")
        leaves = level.where(~nested)
        done = leaves if done is None else done.union(leaves)
        inner = level.where(nested)
        if inner.isEmpty():
            break
        level = _open(spark, inner).select(key, F.concat_ws(".", "metric", "_key").alias("metric"), "_v")
    kind = F.schema_of_variant("_v")
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    value = F.when(number, F.try_variant_get("_v", "$", "double"))
    text = F.when(~number & (kind != "VOID"), F.try_variant_get("_v", "$", "string"))
    return done.select(key, "metric", value.alias("value"), text.alias("text"))


def _open(spark: SparkSession, df: DataFrame) -> DataFrame:
    """One row per entry of the object ``_v``: its name in ``_key``, its content in ``_v``."""
    entries = spark.tvf.variant_explode(F.col("_v").outer()).select(F.col("key").alias("_key"), F.col("value").alias("_entry"))
    return df.lateralJoin(entries).drop("_v").withColumnRenamed("_entry", "_v")
