"""Set algebra of node tables, by _id."""

from __future__ import annotations

from pyspark.sql import DataFrame


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True).dropDuplicates(["_id"])


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("_id"), "_id", "left_semi")


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("_id"), "_id", "left_anti")
