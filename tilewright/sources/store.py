"""Files and tables in storage that driver and executors share.

Whole files (output tiles, sidecars) go through ``pyarrow.fs``, which serves the driver and Python workers alike:
local or mounted paths, and any scheme it knows (hdfs, s3, gs, abfs). Tables are staged below the folder of
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def locate(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def exists(path: str) -> bool:
    system, at = locate(path)
    return system.get_file_info(at).type != fs.FileType.NotFound


def read(path: str) -> bytes:
    """Raises FileNotFoundError where there is none."""
    system, at = locate(path)
    with system.open_input_stream(at) as f:
        return f.read()


def put(folder: str, name: str, data: bytes) -> None:
    """A whole file or none: written under a temporary name and renamed; an object store's put is whole by itself."""
    system, at = locate(folder)
    system.create_dir(at, recursive=True)
    whole = f"{at.rstrip('/')}/{name}"
    renames = system.type_name in ("local", "hdfs")
    part = f"{whole}.{uuid.uuid4().hex}.tmp" if renames else whole
    with system.open_output_stream(part) as f:
        f.write(data)
    if renames:
        if system.type_name == "hdfs" and system.get_file_info(whole).type != fs.FileType.NotFound:
            system.delete_file(whole)  # its rename doesn't replace
        system.move(part, whole)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a fresh temporary one only where none is set (tests)."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="tilewright-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, lineage cut."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)
