"""Sources: site lists, remembered state, captured responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD = "struct<found_at:string,last_checked:string,etag:string,last_modified:string,gmina:string,title:string,url:string,keywords:array<string>,att_sig:string,status:string>"
STATE_FILE = (
    f"schema int, found_items string, urls_seen map<string,string>, content_seen map<string,{RECORD}>, "
    "gmina_seeds map<string,struct<allowed_host:string,start_final:string,seeds:array<string>,ts:string>>, "
    "gmina_frontiers map<string,array<array<string>>>, gmina_retry map<string,array<string>>, dead_urls map<string,array<string>>"
)
COMPLETE = "_COMPLETE"
RESPONSES = "url string, final_url string, kind string, status int, ctype string, err string, ms bigint, body string, etag string, last_modified string, fetched_at timestamp_ntz"


def sites(spark: SparkSession, path: str) -> DataFrame:
    """name, url, pos: rows with both fields, trimmed; https:// where no scheme is given."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").schema("name string, url string").csv(path)
    rows = raw.select(F.trim("name").alias("name"), F.trim("url").alias("url"), F.monotonically_increasing_id().alias("__i")).where("name <> '' and url <> ''")
    rows = rows.withColumn("url", F.when(F.col("url").rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://"), F.col("url")).otherwise(F.concat(F.lit("https://"), F.col("url"))))
    # a list of sites is small; it is numbered in file order
    return rows.withColumn("pos", (F.row_number().over(Window.orderBy("__i")) - 1).cast("long")).drop("__i")


def shard_rows(site_list: DataFrame, shard: int) -> DataFrame:
    """Row number `shard` of the list, or none."""
    return site_list.where(F.col("pos") == shard)


def state_files(spark: SparkSession, *paths: str) -> dict[str, DataFrame]:
    """Tables of one or more state files, of any version: missing sections are empty, unknown ones ignored. A file of the first form, with
    found_items and without a version, counts as empty."""
    raw = spark.read.schema(STATE_FILE).option("multiLine", True).option("mode", "PERMISSIVE").json(list(paths))
    raw = raw.where("not (schema is null and found_items is not null)")
    entries = lambda c: raw.select(F.explode(c).alias("k", "v"))
    return {
        "content_state": entries("content_seen").select(F.col("k").alias("url_key"), "v.*"),
        "urls_seen": entries("urls_seen").select(F.col("k").alias("url_key"), F.col("v").alias("seen_at")),
        "seeds": entries("gmina_seeds").select(F.col("k").alias("site_key"), "v.*"),
        "frontier": entries("gmina_frontiers").select(F.col("k").alias("site_key"), F.posexplode("v").alias("pos", "x")).select("site_key", F.col("x")[0].alias("url"), F.try_element_at("x", F.lit(2)).cast("int").alias("depth"), "pos"),
        "retry": entries("gmina_retry").select(F.col("k").alias("site_key"), F.posexplode("v").alias("pos", "url")),
        "dead_urls": entries("dead_urls").select(F.regexp_replace("k", "^dead_", "").alias("site_key"), F.explode("v").alias("url")),
    }


def empty_state(spark: SparkSession) -> dict[str, DataFrame]:
    shapes = {
        "content_state": "url_key string, found_at string, last_checked string, etag string, last_modified string, gmina string, title string, url string, keywords array<string>, att_sig string, status string",
        "urls_seen": "url_key string, seen_at string",
        "seeds": "site_key string, allowed_host string, start_final string, seeds array<string>, ts string",
        "frontier": "site_key string, url string, depth int, pos int",
        "retry": "site_key string, url string, pos int",
        "dead_urls": "site_key string, url string",
    }
    return {k: spark.createDataFrame([], v) for k, v in shapes.items()}


def load_state(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The newest complete snapshot below a folder that sinks.save_state wrote to; empty tables if there is none."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    runs = sorted(x.getPath().getName() for x in fs.listStatus(top)) if fs.exists(top) else []
    inside = lambda run, name: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{run}/{name}")
    whole = [r for r in runs if fs.exists(inside(r, COMPLETE))]
    out = empty_state(spark)
    if whole:
        out |= {x.getPath().getName(): spark.read.parquet(f"{path}/{whole[-1]}/{x.getPath().getName()}") for x in fs.listStatus(inside(whole[-1], "")) if x.isDirectory()}
    return out


def responses(spark: SparkSession, path: str) -> DataFrame:
    """Captured responses; columns and rows that aren't used stay in the files."""
    return spark.read.schema(RESPONSES).parquet(path)
