"""The folder that the driver and all executors share."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder's URI below spark.checkpoint.dir; only on one machine, where that is unset, below a temporary folder."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("On a cluster spark.checkpoint.dir must name a folder that the driver and all executors share.")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="tessera-"))
        named = "file://" + _own[0]
    elif "://" not in named and not named.startswith("file:"):
        named = "file://" + named
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """rows as a Parquet table of the shared folder, read back: made once, whatever reads it and however often."""
    path = fresh(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
