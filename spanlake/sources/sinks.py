"""Publishing: checks first, then a write into a folder of its own that one pointer makes the table's current version."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanlake.operators.checks import assert_none, below_floor

POINTER = "_CURRENT"


def _files(spark: SparkSession, path: str):
    """(file system of path, a function that makes its paths)."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def _replace(spark: SparkSession, source: str, target: str) -> None:
    """Rename over target in one step (atomic where the file system is); raises if it fails."""
    jvm = spark._jvm
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    make = jvm.org.apache.hadoop.fs.Path
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(make(target).toUri(), spark._jsc.hadoopConfiguration()).rename(make(source), make(target), how)


def point(spark: SparkSession, path: str, version: str) -> None:
    """Make version the current one of path."""
    fs, make = _files(spark, path)
    beside = f"{path}/.{version}.pointer"
    out = fs.create(make(beside), True)
    out.write(bytearray(version.encode()))
    out.close()
    _replace(spark, beside, f"{path}/{POINTER}")


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of path's current version, None before the first."""
    fs, make = _files(spark, path)
    if not fs.exists(make(f"{path}/{POINTER}")):
        return None
    held = fs.open(make(f"{path}/{POINTER}"))
    try:
        return f"{path}/{spark._jvm.org.apache.commons.io.IOUtils.toString(held, 'UTF-8').strip()}"
    finally:
        held.close()


def published(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The current version of a published table."""
    folder = current(spark, path)
    if folder is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    return spark.read.format(fmt).load(folder)


def publish(df: DataFrame, path: str, problems: dict[str, DataFrame] | None = None, least_rows: int = 0, fmt: str = "parquet", partition_by: tuple[str, ...] = (), keep: int = 1) -> str:
    """Assert that no check found a problem, write a new version, point to it; gives the version's name.

    Each writer has a folder of its own, so writers do not meet; the last to point
    wins.  Until the pointer is replaced readers see the version before; if anything
    fails on the way, they still do.  After that, all but the last ``keep`` versions
    before it are removed.
    """
    for what, found in (problems or {}).items():
        assert_none(found, what)
    if least_rows:
        assert_none(below_floor(df, least_rows), f"rows for {path}")
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    writer = df.write.mode("error").format(fmt)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(f"{path}/{version}")
    fs, make = _files(spark, path)
    if not fs.exists(make(f"{path}/{version}")):
        raise OSError(f"{path}/{version} was not written")
    point(spark, path, version)
    held = sorted((s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(make(path)) if s.getPath().getName().startswith("v-") and s.getPath().getName() != version)
    for _, name in held[: max(0, len(held) - keep)]:
        fs.delete(make(f"{path}/{name}"), True)
    return version


def as_json_lines(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One JSON string per row, nulls kept; keys in the order given, or sorted if none is given."""
    return df.select(F.to_json(F.struct(*(sorted(df.columns) if columns is None else columns)), {"ignoreNullFields": "false"}).alias("value"))


def appended(existing: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Append-only upsert: existing rows stay as people edited them, new keys follow; sorted."""
    return existing.unionByName(new.join(existing.select(key), key, "left_anti").select(*existing.columns)).orderBy(*order)
