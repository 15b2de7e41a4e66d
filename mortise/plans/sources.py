"""Queries over files that Spark writes from the tables and reads back, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from mortise.session import shared_folder, table
from mortise.sources import sqlite, workbook


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def sqlite_year_scan(spark: SparkSession, sf: str) -> DataFrame:
    """All orders as SQLite files with an index on the year, of which one year is read by a pushed filter and five columns."""
    path = _folder(spark, "orders-sqlite")
    orders = table(spark, sf, "orders").withColumn("o_year", F.year("o_orderdate"))
    sqlite.write_sqlite(orders, path, "orders", [["o_year"], ["o_custkey", "o_year"]])
    read = sqlite.read_sqlite(spark, path, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_year"])
    return read.where("o_year = 1995 and o_totalprice > 1000")


def workbook_rows(spark: SparkSession, sf: str) -> DataFrame:
    """All suppliers as workbooks, one a partition, read back by header and type."""
    path = _folder(spark, "suppliers-workbooks")
    workbook.write_workbooks(table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), path, "suppliers")
    return workbook.read_workbook(spark, path, "suppliers", "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")


def workbook_report(spark: SparkSession, sf: str) -> DataFrame:
    """A report of two sheets with different headers, united by column name."""
    path = _folder(spark, "report")
    workbook.write_workbook({"nations": table(spark, sf, "nation").select("n_name", "n_regionkey"), "regions": table(spark, sf, "region").select("r_name", "r_regionkey")}, path)
    rows = workbook.by_header(workbook.read_cells(spark, path), ["n_name", "n_regionkey", "r_name", "r_regionkey"])
    return rows.select("sheet", F.coalesce("n_name", "r_name").alias("name"), F.coalesce("n_regionkey", "r_regionkey").cast("int").alias("regionkey"))


QUERIES = {f.__name__: f for f in (sqlite_year_scan, workbook_rows, workbook_report)}

ORACLES = {
    "sqlite_year_scan": "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice, CAST(year(o_orderdate) AS BIGINT) AS o_year FROM orders WHERE year(o_orderdate) = 1995 AND o_totalprice > 1000",
    "workbook_rows": "SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name, CAST(s_nationkey AS INTEGER) AS s_nationkey, CAST(s_acctbal AS DOUBLE) AS s_acctbal FROM supplier",
    "workbook_report": "SELECT 'nations' AS sheet, n_name AS name, CAST(n_regionkey AS INTEGER) AS regionkey FROM nation UNION ALL SELECT 'regions', r_name, CAST(r_regionkey AS INTEGER) FROM region",
}
