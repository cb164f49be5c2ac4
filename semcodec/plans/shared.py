"""The folder that driver and executors share, tables and small files in it."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_REPOSITORY = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def workers_see_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _REPOSITORY not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_REPOSITORY, *paths])


def root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the context's checkpoint folder; a session on this machine alone that has neither gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="semcodec-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def folder(spark: SparkSession) -> str:
    """A new place in it, deleted when the session's JVM exits."""
    path = f"{root(spark)}/semcodec-{uuid.uuid4().hex}"
    files, where = _files(spark, path)
    files.deleteOnExit(where)
    return path


def written(rows: DataFrame) -> DataFrame:
    """rows as a table there: the lineage ends, and any executor can reread it."""
    path = folder(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def put(spark: SparkSession, path: str, body: str) -> str:
    """A small file of settings or of a trial."""
    files, where = _files(spark, path)
    out = files.create(where, True)
    try:
        out.write(bytearray(body.encode()))
    finally:
        out.close()
    return path


def text_of(spark: SparkSession, path: str) -> str:
    """What put() wrote."""
    files, where = _files(spark, path)
    stream = files.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _files(spark, path)
    return files.exists(where)


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """The files that a pattern names, sorted."""
    files, where = _files(spark, pattern)
    return sorted(x.getPath().toString() for x in files.globStatus(where) or [])
