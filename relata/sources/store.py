"""Tables written to a folder that all executors share, to cut lineage or to keep relvars."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from relata.types import RelationError

_FOLDERS: dict[str, str] = {}


def _drop(folder: str) -> None:
    with contextlib.suppress(Exception):
        store, path = fs.FileSystem.from_uri(folder)
        store.delete_dir(path)


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir, removed when the driver's process ends.

    Where that setting is unset, as in tests, it is a folder of this machine.
    """
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not spark.sparkContext.master.startswith("local"):
            raise RelationError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = base or "file://" + tempfile.mkdtemp(prefix="relata-")
        _FOLDERS[app] = f"{base.rstrip('/')}/relata-{app}"
        atexit.register(_drop, _FOLDERS[app])
    return _FOLDERS[app]


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package. On a cluster it comes with --py-files; this serves one machine."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH", ""), root]))


def settle(df: DataFrame) -> DataFrame:
    """df, written once and read back; frames without columns have at most one row and stay as they are."""
    if not df.columns:
        return df
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
