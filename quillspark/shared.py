"""The folder that the driver and all executors share."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of this machine if Spark runs in this process alone, as in tests.

    Elsewhere that is an error, since each executor would write to a disk of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of an address, as Spark itself reaches it."""
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), made


def read_json(spark: SparkSession, path: str) -> dict | None:
    """A small JSON file, or None if it isn't there."""
    system, place = hadoop_path(spark, path)
    if not system.exists(place):
        return None
    stream = system.open(place)
    try:
        return json.loads(bytes(b & 255 for b in stream.readAllBytes()).decode())
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """Writes a small JSON file beside its place, then moves it there."""
    system, place = hadoop_path(spark, path)
    _, fresh = hadoop_path(spark, f"{path}.{uuid.uuid4().hex}")
    stream = system.create(fresh, True)
    try:
        stream.write(bytearray(json.dumps(value).encode()))
    finally:
        stream.close()
    system.delete(place, False)
    if not system.rename(fresh, place):
        raise OSError(f"{path} can't be written")
