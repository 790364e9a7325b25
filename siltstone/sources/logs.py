"""Log analytics over JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.schema import LOG


def read(spark: SparkSession, path: str) -> DataFrame:
    """Log lines; ones that aren't JSON objects are dropped."""
    return spark.read.schema(LOG).option("mode", "DROPMALFORMED").json(path).filter("timestamp is not null or level is not null or target is not null")


def on_date(date: str, c: str = "timestamp") -> Column:
    if len(date) != 10 or date[4] != "-":
        raise ValueError(f"not a date: {date!r}")
    return F.to_date(c) == F.lit(date).cast("date")


def by_level(logs: DataFrame) -> DataFrame:
    return logs.groupBy("level").agg(F.count("*").alias("entries"))


def top_targets(logs: DataFrame, n: int = 10) -> DataFrame:
    return logs.groupBy("target").agg(F.count("*").alias("entries")).orderBy(F.desc("entries"), "target").limit(n)


def operations(logs: DataFrame, span: str = "span.name") -> DataFrame:
    return logs.filter(F.col(span).isNotNull()).groupBy(F.col(span).alias("operation")).agg(F.count("*").alias("entries"))


def errors(logs: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    return logs.filter("level = 'ERROR'").orderBy(*order).limit(n)


def by_date(logs: DataFrame, c: str = "timestamp") -> DataFrame:
    return logs.groupBy(F.to_date(c).alias("date")).agg(F.count("*").alias("entries"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """(name, date, number, size) of log files, sorted by date and number; contents aren't read."""
    name = F.element_at(F.split("path", "/"), -1)
    f = spark.read.format("binaryFile").load(path).select(name.alias("name"), F.col("length").alias("size"))
    found = lambda g: F.nullif(F.regexp_extract("name", r"(\d{4}-\d{2}-\d{2})(?:\.(\d+))?", g), F.lit(""))
    return f.select("name", found(1).cast("date").alias("date"), F.coalesce(found(2).cast("int"), F.lit(0)).alias("number"), "size").orderBy("date", "number", "name")


def totals(file_rows: DataFrame) -> DataFrame:
    return file_rows.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def expired(file_rows: DataFrame, today: str, days: int = 30) -> DataFrame:
    return file_rows.filter(F.col("date") < F.date_sub(F.lit(today).cast("date"), days))
