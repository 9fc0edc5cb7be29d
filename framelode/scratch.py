"""Shared scratch tables: the only way this library cuts lineage.

Tables go to the folder that the session names in ``spark.checkpoint.dir``, which
every executor and the driver share, so losing an executor never loses them. There they lie in
``framelode/<application id>``; nothing else is ever deleted.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only where none is set (local tests)."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.conf.get("framelode.scratch", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="framelode-")
        spark.conf.set("framelode.scratch", root)
    return root.rstrip("/")


#: The tables of this process, oldest first.
CREATED: list[str] = []


def scratch_folder(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/framelode/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str, packed: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared scratch folder and read it back. ``packed``: its values are compressed already."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="none" if packed else None)
    CREATED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder of any store that Spark reaches."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Delete the tables made since there were ``since``, but for the last ``keep``: once what was computed from them is written."""
    end = len(CREATED) - keep
    for path in CREATED[since:end]:
        delete(spark, path)
    del CREATED[since:end]


def purge(spark: SparkSession) -> None:
    """Delete this application's scratch tables. Call when no DataFrame of this library is in use."""
    delete(spark, scratch_folder(spark))
    CREATED.clear()
