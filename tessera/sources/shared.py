"""The folder that the driver and all executors share, and places in it for one query's files."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Only on one machine (a local master, as in tests) a temporary folder is set where the session names none; on a cluster that is an error.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    got = spark.sparkContext.getCheckpointDir()
    if not got:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        got = spark.sparkContext.getCheckpointDir()
    return got.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, in the JVM."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a new, uniquely named folder in the shared one; what is written there stays."""
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; it goes when the driver's JVM ends."""
    path = new_folder(spark, name)
    place, files = hadoop_path(spark, path)
    files.mkdirs(place)
    files.deleteOnExit(place)
    return path


def as_local(path: str) -> str:
    """The path as the machine's own, for what is opened as a file; other stores are refused."""
    own = re.sub(r"^file:/*", "/", path)
    if re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:", own):
        raise ValueError(f"{path} can't be opened as a file: mount the store, or read its lines with numbered_lines")
    return own
