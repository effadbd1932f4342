"""Session helpers shared by entry points and tests."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context.

    Python workers import the functions they run, and on a cluster they do not
    share the driver's folders or its ``sys.path``.
    """
    context = spark.sparkContext
    if getattr(context, "_skytally_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp()) / "skytally.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, os.path.relpath(path, root.parent))
    context.addPyFile(str(target))
    context._skytally_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; one of this machine only where Spark runs on it alone."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (base or "file:///tmp/checkpoints/skytally").rstrip("/")


class Steps:
    """Writes one table after another and deletes each when the next is written, so that later jobs do not make the earlier ones again."""

    def __init__(self) -> None:
        self._last: DataFrame | None = None

    def __call__(self, df: DataFrame) -> DataFrame:
        written = cut_lineage(df)
        if self._last is not None:
            discard(self._last)
        self._last = written
        return written


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``cut_lineage`` wrote and nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/step-" not in folder:
            raise ValueError(f"{folder} is not an intermediate table")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the folder that all executors share, and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
