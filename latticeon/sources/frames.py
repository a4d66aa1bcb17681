"""Loading nodes and edges from pandas or Spark frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import as_collection


def to_spark(spark: SparkSession, frame) -> DataFrame:
    return frame if isinstance(frame, DataFrame) else spark.createDataFrame(frame)


def nodes_of(spark: SparkSession, frame, collection: str, id_col: str, mapping: dict[str, str] | None = None) -> DataFrame:
    """Rows as nodes; NaN in float columns counts as missing."""
    df = to_spark(spark, frame)
    mapping = mapping or {}
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            df = df.withColumn(name, F.when(~F.isnan(name), F.col(name)))
    df = df.withColumn("__key", F.col(id_col).cast("string"))
    drop = [c for c in (id_col,) if mapping.get(c) == "_key"]
    df = df.withColumnsRenamed({k: v for k, v in mapping.items() if v != "_key"}).drop(*drop)
    return as_collection(df, collection, "__key").drop("__key")


def edges_of(spark: SparkSession, frame, source_col: str, target_col: str, edge_type: str | None = None, type_col: str | None = None, source_collection: str | None = None, target_collection: str | None = None, weight_col: str | None = None, meta_cols=()) -> DataFrame:
    """Rows as edges. Keys without a slash get their collection in front; meta columns become one JSON text."""
    df = to_spark(spark, frame)

    def slug(col: str, coll: str | None):
        c = F.col(col).cast("string")
        return c if coll is None else F.when(F.contains(c, F.lit("/")), c).otherwise(F.concat(F.lit(coll + "/"), c))

    kind = F.col(type_col).cast("string") if type_col else F.lit(edge_type)
    weight = F.coalesce(F.col(weight_col).cast("float"), F.lit(1.0).cast("float")) if weight_col else F.lit(1.0).cast("float")
    meta = F.to_json(F.struct(*meta_cols)) if meta_cols else F.lit(None).cast("string")
    return df.select(slug(source_col, source_collection).alias("src"), slug(target_col, target_collection).alias("dst"), kind.alias("type"), weight.alias("strength"), meta.alias("meta"))
