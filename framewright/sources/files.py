"""Message, timeline and log files as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schemas import TIMELINE


#: Sample files: those of that name, and those that ``write_topic_jsonl`` writes.
SAMPLES = "{*.jsonl,part-*.txt}"


def read_samples(spark: SparkSession, root: str, pattern: str = SAMPLES) -> DataFrame:
    """Sample files laid out as root/topic/*.jsonl: topic, path and msg, one row per line.

    The topic is the directory name; directories without such files do not appear. What ``write_topic_jsonl`` wrote is
    read as well.
    """
    path = F.col("_metadata.file_path")
    return (
        spark.read.option("pathGlobFilter", pattern).option("basePath", root).text(f"{root.rstrip('/')}/*")
        .select(topic_of(path).alias("topic"), path.alias("path"), F.col("value").alias("msg"))
    )


def sample_files(spark: SparkSession, root: str, pattern: str = SAMPLES) -> DataFrame:
    """Sample files with their size, as ``budget_prefix`` needs them: topic, path, length."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(f"{root.rstrip('/')}/*")
    return files.select(topic_of(F.col("path")).alias("topic"), "path", "length")


def topic_of(path: Column) -> Column:
    """Name of the directory a file is in, without the ``topic=`` of partitioned output."""
    return F.url_decode(F.regexp_extract(path, r"(?:^|/)(?:topic=)?([^/]+)/[^/]+\z", 1))


def read_messages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed JSON lines; a line that does not parse is kept in the column ``corrupt``."""
    return spark.read.schema(f"{schema}, corrupt STRING").option("columnNameOfCorruptRecord", "corrupt").json(path)


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    """Health samples from CSV files with a header line."""
    return spark.read.schema(TIMELINE).option("header", True).csv(path)


# Fields of the two log formats that get a column of their own.
LOG_FIELDS = ("timestamp", "level", "event", "message", "service", "logger")


def log_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """JSON log lines of both formats as ts, level, event, service and the other fields as a map.

    A line that is no JSON object stays as a row with the line in ``corrupt``; blank lines are left out.
    """
    fields = F.from_json(F.col(value), "map<string,string>")
    rows = lines.filter(F.trim(value) != "").select(fields.alias("m"), F.col(value).alias("_line"))
    field = lambda name: F.try_element_at("m", F.lit(name))
    # one of the formats writes UTC without saying so
    at = field("timestamp")
    zoned = at.rlike(r"(Z|[+-]\d\d:?\d\d)\z")
    return rows.select(
        F.try_to_timestamp(F.when(zoned, at).otherwise(F.concat(at, F.lit("Z")))).alias("ts"),
        F.upper(field("level")).alias("level"),
        F.coalesce(field("event"), field("message")).alias("event"),
        F.coalesce(field("service"), field("logger")).alias("service"),
        F.map_filter("m", lambda key, value: ~key.isin(*LOG_FIELDS)).alias("extras"),
        F.when(F.col("m").isNull(), F.col("_line")).alias("corrupt"),
    )


def read_log_events(spark: SparkSession, path: str) -> DataFrame:
    return log_events(spark.read.text(path))
