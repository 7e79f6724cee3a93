"""Source files as DataFrames: recursive scan, checksum, line ends, module names, test frameworks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "file_id long, path string, module string, dir string, crc long, fmt string, content string"


def file_format(content: Column) -> Column:
    """``dos``, ``mac`` or ``unix`` by the line ends used."""
    return F.when(content.contains("\r\n"), "dos").when(content.contains("\r"), "mac").otherwise("unix")


def _complete(df: DataFrame) -> DataFrame:
    content = F.coalesce("content", F.lit(""))
    return df.select(
        F.xxhash64("path").alias("file_id"),
        "path",
        F.regexp_extract("path", r"([^/]+)\.[A-Za-z]+$", 1).alias("module"),
        F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"),
        F.crc32(F.encode(content, "UTF-8")).alias("crc"),
        file_format(content).alias("fmt"),
        content.alias("content"),
    )


def read_files(spark: SparkSession, paths: str | list[str], extension: str = "erl") -> DataFrame:
    """Each file below ``paths`` with the extension once, whole; missing and corrupt files are passed over."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{extension}").option("wholetext", True)
    reader = reader.option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True)
    given = {p.rstrip("/") or "/" for p in ([paths] if isinstance(paths, str) else paths)}
    roots = sorted(p for p in given if not any(p != q and p.startswith(q.rstrip("/") + "/") for q in given))  # a file is below one root only
    df = reader.format("text").load(roots).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return _complete(df)


def from_strings(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """The same table from path -> text."""
    return _complete(spark.createDataFrame(sorted(files.items()), "path string, content string"))


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Status of each path between two scans: new, changed, unchanged or deleted."""
    a = old.select("path", F.col("crc").alias("was"))
    b = new.select("path", F.col("crc").alias("now"))
    status = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("was") == F.col("now"), "unchanged").otherwise("changed")
    return a.join(b, "path", "full").select("path", status.alias("status"))


def module_files(files: DataFrame, modules: Iterable[str]) -> DataFrame:
    """Paths of the named modules."""
    return files.where(F.col("module").isin(*modules)).select("module", "path")


def test_framework(files: DataFrame, includes: DataFrame) -> DataFrame:
    """``path, framework``: by included headers, and by the name of common-test suites."""
    known = F.when(F.col("include").endswith("eunit.hrl"), "eunit").when(F.col("include").endswith("eqc.hrl"), "eqc").when(F.col("include").endswith("proper.hrl"), "proper")
    by_header = includes.join(files.select("file_id", "path"), "file_id").select("path", known.alias("framework")).where("framework is not null")
    return by_header.union(files.where(F.col("module").endswith("_SUITE")).select("path", F.lit("ct"))).distinct()
