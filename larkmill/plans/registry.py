"""Registration of queries with their SQL, table access, and the catalog text that the extraction queries run over."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkmill.operators.relate import dealt
from larkmill.sources.scratch import path as scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
__all__ = ["CATALOG_SQL", "ORACLES", "QUERIES", "catalog", "query", "scratch", "table", "written"]

#: Runs unchanged in Spark and in DuckDB.
CATALOG = """concat('Item Name: ', p_type, ' ', upper(substr(p_name,1,1)), substr(p_name,2), ', ',
  CASE p_partkey % 4 WHEN 0 THEN 'organic' WHEN 1 THEN 'vegan' WHEN 2 THEN 'premium gourmet' ELSE 'plain' END, ' ',
  CASE p_partkey % 3 WHEN 0 THEN 'tea' WHEN 1 THEN 'soup' ELSE 'cereal' END, ', ',
  CAST(p_size AS VARCHAR(9)), ' ',
  CASE p_partkey % 5 WHEN 0 THEN 'oz' WHEN 1 THEN 'ml' WHEN 2 THEN 'lb' WHEN 3 THEN 'fl oz' ELSE 'ct' END,
  ' (Pack of ', CAST(p_partkey % 6 + 1 AS VARCHAR(9)), ')', chr(10),
  'Value: ', CAST(p_size AS VARCHAR(9)), '.5', chr(10), 'Unit: ',
  CASE p_partkey % 4 WHEN 0 THEN 'Ounce' WHEN 1 THEN 'Fl Oz' WHEN 2 THEN 'Pound' ELSE 'Count' END)"""
CATALOG_SQL = f"catalog AS (SELECT *, {CATALOG} AS text FROM part)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def catalog(spark: SparkSession, d: str) -> DataFrame:
    """Dealt by rows: rules over a text cost much, and the table has few bytes, so it lies in few files."""
    return dealt(table(spark, d, "part"), "p_partkey", 20_000).selectExpr("*", f"{CATALOG} AS text")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, where several passes read it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
