"""Readers with fixed schemas; nothing is inferred."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from spanlake.functions.text import fingerprint, repaired

SOURCE = "source_id long, owner_id string, source_type string, lang string, url string, title string, text string, retrieved date, loaded_at timestamp"
SPAN = "owner_id string, kind string, category string, flashpoints array<string>, quote string, source_url string, source_type string, char_start int, char_end int"
VOTE = "vote_id string, municipality string, source_kind string, meeting_date date, item_number string, title string, meeting_type string, outcome string, resolution_text string, district_categories array<string>, minutes_url string, loaded_at timestamp"
REVIEW = "vote_id string, status string, issues array<string>, summary string, votes map<string,string>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def landed_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, key, retrieved, text) of fetched files; bytes that are no UTF-8 are read as Latin-1."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return raw.select("path", fingerprint(F.col("path")).alias("key"), F.to_date("modificationTime").alias("retrieved"), repaired(F.col("content")).alias("text"))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def json_records(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """Records of JSON files; malformed ones are dropped."""
    return spark.read.schema(schema).option("multiLine", multi_line).option("mode", "DROPMALFORMED").json(path)


def log_lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return (spark.readStream if stream else spark.read).text(path)


def xml_rows(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def yaml_dimension(spark: SparkSession, path: str, schema: str, key: str = "entries", most: int = 100_000, most_bytes: int = 16 << 20) -> DataFrame:
    """A small hand-kept YAML list (or mapping with the list under key), in any file system that Spark reads, as a table."""
    import yaml

    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    if file.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(file).getLen() > most_bytes:
        raise ValueError("a YAML dimension is a short list")
    data = yaml.safe_load(whole_texts(spark, path).first()["text"]) or []
    rows = data.get(key, []) if isinstance(data, dict) else data
    if len(rows) > most:
        raise ValueError("a YAML dimension is a short list")
    parsed = T._parse_datatype_string(schema)
    lines = [json.dumps(r, default=str, ensure_ascii=False) for r in rows]
    return spark.createDataFrame([(x,) for x in lines], "v string").select(F.from_json("v", parsed).alias("r")).select("r.*")


def at_least(df: DataFrame, rows: int, what: str) -> DataFrame:
    """df, after a count against a floor."""
    from spanlake.operators.checks import assert_none, below_floor

    assert_none(below_floor(df, rows), f"too few rows of {what}")
    return df
