"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and the master is local (tests). Elsewhere executors would each write to a disk of their own."""
    if not (folder := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{(made := tempfile.mkdtemp(prefix='corpuslens-'))}"
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}/{name}"


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def path_exists(spark: SparkSession, path: str) -> bool:
    files, at = _file_system(spark, path)
    return files.exists(at)


def delete_path(spark: SparkSession, path: str) -> None:
    """Only ever given paths of new_path, and folders of a store that its own functions wrote."""
    files, at = _file_system(spark, path)
    files.delete(at, True)
