"""Getting the package to the executors, and the folder that all machines share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

HERE = os.path.dirname(os.path.abspath(__file__))
_sent: set[str] = set()
_made: list[str] = []
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's sources to the executors, once for each application, so that Python functions can be imported there,
    and keeps Arrow batches small."""
    if spark.conf.get(ARROW_BYTES) in ("67108864b", "64MB", "64m"):
        spark.conf.set(ARROW_BYTES, "8m")  # only the default is changed: batches of 64 MB of text are large for Python workers
    app = spark.sparkContext.applicationId
    if app not in _sent:
        path = os.path.join(tempfile.mkdtemp(), "tidewatch_sources.zip")
        with zipfile.ZipFile(path, "w") as z:
            for top, _, names in os.walk(HERE):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(top, name)
                        z.write(full, os.path.join("tidewatch", os.path.relpath(full, HERE)))
        spark.sparkContext.addPyFile(path)
        _sent.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all machines share. Only a session on one machine may lack that setting."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        top = "/tmp/checkpoints"
    _made.append(f"{top.rstrip('/')}/{uuid.uuid4().hex}")
    return _made[-1]


def written(df: DataFrame) -> DataFrame:
    """df as a written table in the shared folder: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> int:
    """Deletes the folders made by this process so far: for when results have been saved, since they may read them. Returns their number."""
    jvm, n = spark._jvm, len(_made)
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n
