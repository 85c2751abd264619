"""Sinks: state snapshots, hits, diagnostics, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT
from .readers import COMPLETE


def save_state(tables: dict[str, DataFrame], path: str, run: str) -> None:
    """A snapshot folder for each run, whose names ascend; a mark at the end makes it complete, and readers.load_state takes the newest complete
    one, so a run that fails midway changes nothing."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{run}/{name}")
    spark = next(iter(tables.values())).sparkSession
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{run}/{COMPLETE}")
    mark.getFileSystem(spark._jsc.hadoopConfiguration()).create(mark).close()


def save_by_site(state: DataFrame, path: str, key: str = "site_key") -> None:
    state.write.mode("overwrite").partitionBy(key).parquet(path)


def append_hits(hits: DataFrame, path: str) -> None:
    hits.select("gmina", "keyword", "title", "url", "status", "found_at").write.mode("append").option("header", True).csv(path)


def append_diagnostics(sites: DataFrame, errors: DataFrame, path: str) -> None:
    """Once a run. Maps are written as JSON."""
    sites.withColumn("counts", F.to_json("counts")).write.mode("append").option("header", True).csv(f"{path}/sites")
    errors.write.mode("append").option("header", True).csv(f"{path}/errors")


def hit_lines(hits: DataFrame) -> DataFrame:
    """Console lines: title collapsed, cut at 180."""
    return hits.select(F.concat_ws(" | ", "gmina", "keyword", F.left(F.regexp_replace(F.coalesce("title", F.lit("")), r"(?U)\s+", " "), F.lit(180)), "url", "status").alias("line"))


def top_items(items: DataFrame, order: list[str], n: int = DEFAULT.summary_items) -> DataFrame:
    return items.orderBy(*order).limit(n)
