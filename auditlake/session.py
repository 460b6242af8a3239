"""What a Spark session needs: this package on the executors, and a folder that all of them share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Python workers import the functions of this package by name, so they need its files: Spark's own file server hands them out as a zip."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    here = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as made:
        copy = Path(made, "tree", here.name)
        shutil.copytree(here, copy, ignore=shutil.ignore_patterns("__pycache__"))
        keep = tempfile.mkdtemp(prefix=f"{here.name}-")
        context.addPyFile(shutil.make_archive(f"{keep}/{here.name}", "zip", copy.parent))
    _sent.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where that is unset under a local master (tests) a temporary one, which then becomes the setting. On a
    cluster an unset folder is an error: each machine would write to a disk of its own."""
    try:
        found = spark.conf.get("spark.checkpoint.dir")
    except Exception:  # unset
        found = None
    if not found:
        context = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = context.get() if context.isDefined() else None
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not found:
        made = tempfile.mkdtemp(prefix="auditlake-shared-")
        atexit.register(shutil.rmtree, made, True)
        found = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/auditlake/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """The table, written once to the shared folder: what several parts of a plan read."""
    folder = new_folder(df.sparkSession, what)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def put_files(spark: SparkSession, folder: str, files: dict[str, str]) -> None:
    """Small texts as files of a folder, by Spark's own file system."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name, text in files.items():
        p = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        out = p.getFileSystem(conf).create(p, True)
        out.write(bytearray(text.encode()))
        out.close()
