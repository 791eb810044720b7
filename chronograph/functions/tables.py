"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``; a local master (tests) without that setting gets a
    temporary one, any other is refused."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="chronograph-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
        _folders[app] = f"{base.rstrip('/')}/tables-{app}"
    return _folders[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table: written once and read back, so that what follows neither recomputes it nor depends on the
    executors that made it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
