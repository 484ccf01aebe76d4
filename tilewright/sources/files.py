"""Tables in files: tile lists and journals as lines of JSON, and the output folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import tiles as fn
from tilewright.schema import JOURNAL, REQUIRED, TILE, TILE_COLUMNS


class JournalParseError(ValueError):
    """A line of a journal is no failure record."""


def with_defaults(tiles: DataFrame) -> DataFrame:
    return tiles.withColumns({"out_row": F.coalesce("out_row", "row"), "out_col": F.coalesce("out_col", "col"), "lineage": F.coalesce("lineage", F.array().cast("array<int>"))})


def visible(spark: SparkSession, path: str) -> str:
    """A path that Spark's readers take: they skip names that begin with an underscore, so such a file (a
    journal, which holds failures only) is copied beside its place by the file system first."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getName().startswith("_"):
        return path
    copy = jvm.org.apache.hadoop.fs.Path(f"{at.getParent().toString()}/_staging/{uuid.uuid4().hex}{at.getName()}".replace(at.getName(), at.getName().lstrip("_")))
    fs = at.getFileSystem(conf)
    jvm.org.apache.hadoop.fs.FileUtil.copy(fs, at, fs, copy, False, conf)
    fs.deleteOnExit(copy)
    return copy.toString()


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """A tile list; a malformed line fails the job, unknown fields are ignored."""
    return with_defaults(spark.read.schema(TILE).option("mode", "FAILFAST").json(visible(spark, path)))


def parse_journal(lines: DataFrame) -> DataFrame:
    """Records of the text column ``value``, with the line as ``raw`` and whether it is ``valid``."""
    parsed = lines.where(F.trim("value") != "").select(F.col("value").alias("raw"), F.from_json("value", JOURNAL, {"mode": "PERMISSIVE"}).alias("j")).select("raw", "j.*")
    valid = F.lit(True)
    for c in REQUIRED:
        valid = valid & F.col(c).isNotNull()
    return with_defaults(parsed.withColumn("valid", valid))


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """Strict: raises for a line that isn't JSON or lacks a required field; blank lines are skipped."""
    records = parse_journal(spark.read.text(visible(spark, path)))
    bad = records.where("not valid").select("raw").limit(1).collect()
    if bad:
        raise JournalParseError(f"not a failure record: {bad[0].raw[:200]}")
    return records.drop("valid")


def failure_keys(spark: SparkSession, path: str) -> DataFrame:
    """Lenient: distinct (row, col) of the lines that have them."""
    return keys_of(spark.read.text(visible(spark, path)))


def keys_of(lines: DataFrame) -> DataFrame:
    """Distinct (row, col) of the lines of the text column ``value`` that have them; other lines are passed over."""
    lines = lines.where(F.trim("value") != "")
    return lines.select(F.from_json("value", "row int, col int").alias("j")).select("j.*").dropna().distinct()


def output_files(spark: SparkSession, path: str) -> DataFrame:
    """out_row, out_col, name, length of the output files in a folder; their lengths' sum is what a copy would move."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "tile_r*_c*.tif").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    return listed.withColumns({"out_row": fn.filename_key(F.col("name"), "row"), "out_col": fn.filename_key(F.col("name"), "col")}).dropna()


def total_size(listed: DataFrame) -> DataFrame:
    """files, bytes: what a copy of an output folder would move."""
    return listed.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def write_tiles(tiles: DataFrame, path: str) -> None:
    """A tile list as one file of JSON lines, which ``read_tiles`` takes."""
    write_lines(tiles.select(F.to_json(F.struct(*TILE_COLUMNS)).alias("value")), path)


def write_lines(lines: DataFrame, path: str) -> None:
    """A text column as one file at exactly ``path``.

    Tasks write parts side by side; the driver streams them into one file, a buffer at a time, which then takes the
    old one's place in a single rename.
    """
    spark = lines.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    beside = hadoop.Path(f"{at.getParent().toString()}/_staging/{uuid.uuid4().hex}")
    fs = at.getFileSystem(conf)
    whole = hadoop.Path(beside, "whole")
    try:
        lines.write.text(hadoop.Path(beside, "parts").toString())
        out = fs.create(whole)
        try:
            for s in sorted(fs.listStatus(hadoop.Path(beside, "parts")), key=lambda s: s.getPath().getName()):
                if s.getPath().getName().startswith("part-"):
                    read = fs.open(s.getPath())
                    try:
                        jvm.org.apache.hadoop.io.IOUtils.copyBytes(read, out, conf, False)
                    finally:
                        read.close()
        finally:
            out.close()
        modes = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        modes[0] = hadoop.Options.Rename.OVERWRITE
        hadoop.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(whole), fs.makeQualified(at), modes)
        if fs.getScheme() == "file":  # people edit journals; a checksum beside them would then make them unreadable
            fs.getRaw().delete(hadoop.Path(at.getParent(), f".{at.getName()}.crc"), False)
    finally:
        fs.delete(beside, True)
