"""Tables in the folder that all executors share: they end a plan's lineage, so losing an executor costs nothing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders written by ``stored`` in this process and not yet released.
_WRITTEN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a local session gets a folder of its own; a cluster's executors would each have another one, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pagemill-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/pagemill-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in time for ``release``."""
    return len(_WRITTEN)


def release(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Deletes what was stored since a mark, but for the folders to keep: to be called when the results that read it are written."""
    gone = [p for p in _WRITTEN[since:] if p not in keep]
    _WRITTEN[since:] = [p for p in _WRITTEN[since:] if p in keep]
    for path in gone:
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def last_stored() -> str:
    """The folder that the last ``stored`` wrote."""
    return _WRITTEN[-1]


def stored_bytes(table: DataFrame) -> int:
    """Bytes of the files that a stored table is read from, as the planner sees them."""
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
