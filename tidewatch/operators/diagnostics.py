"""Counts of what happened, per site and over all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, WatchConfig


def counts(events: DataFrame, by: list[str], key: str, amount: str | None = None) -> DataFrame:
    """by..., counts MAP<STRING, BIGINT>: sums (or rows) of each key."""
    one = events.groupBy(*by, key).agg((F.sum(amount) if amount else F.count("*")).cast("long").alias("__n"))
    return one.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "__n")))).alias("counts"))


def problem_hosts(responses: DataFrame, host: str, config: WatchConfig = DEFAULT) -> DataFrame:
    """Hosts with more reports of 403, 429 or block pages than are tolerated."""
    bad = F.col("status").isin(403, 429) | (F.col("kind") == "blocked")
    return responses.where(bad).groupBy(host).agg(F.count("*").alias("reports")).where(F.col("reports") > config.problem_reports)


def error_samples(errors: DataFrame, by: list[str], order: list[str], config: WatchConfig = DEFAULT) -> DataFrame:
    """The first errors of each site; a report, so the bound is the feature."""
    return errors.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("n") <= config.error_samples)


def all_of_last(rows: DataFrame, by: list[str], order: list[str], condition, n: int = 8) -> DataFrame:
    """Column `all_bad`: this row and the n - 1 before it all meet the condition."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(n - 1), 0)
    return rows.withColumn("all_bad", (F.count("*").over(w) == n) & F.min(condition).over(w))


def site_status(sites: DataFrame) -> DataFrame:
    """START_FAIL, WORKER_ERROR, INCOMPLETE or OK from started, failed, stopped."""
    return sites.withColumn("status", F.when(~F.col("started"), "START_FAIL").when(F.col("failed"), "WORKER_ERROR").when(F.col("stopped"), "INCOMPLETE").otherwise("OK"))


def summary(sites: DataFrame) -> DataFrame:
    return sites.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "OK").alias("ok"), F.count_if(F.col("status") == "START_FAIL").alias("start_fail"))


def start_fail_report(attempts: DataFrame, by: str = "gmina", order: str = "ordinal", shown: int = 8) -> DataFrame:
    """Lines of the report on sites without a start page: the number of attempts, then the first ones. attempts: by, order, try_url, kind,
    status, ms; a report, so the bound is the feature."""
    w = Window.partitionBy(by)
    rows = attempts.withColumn("n", F.row_number().over(w.orderBy(order))).withColumn("all", F.count("*").over(w))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    head = rows.where("n = 1").select(by, F.lit(0).alias("n"), F.concat(F.lit("start_attempts="), "all").alias("line"))
    line = F.concat(F.lpad(F.col("n").cast("string"), 2, "0"), F.lit(") kind="), text("kind"), F.lit(" status="), text("status"), F.lit(" ms="), text("ms"), F.lit(" url="), F.left("try_url", F.lit(100)))
    return head.unionByName(rows.where(F.col("n") <= shown).select(by, "n", line.alias("line")))
