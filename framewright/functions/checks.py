"""Validation as columns: null means valid, otherwise the first rule that fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

# Size limits and name patterns.
MAX_TOPIC_LENGTH = 255
MAX_DICT_ID_LENGTH = 128
MAX_MESSAGE_BYTES = 10 * 1024 * 1024
MAX_BATCH_BYTES = 100 * 1024 * 1024
TOPIC_PATTERN = r"^[a-zA-Z0-9._-]+\z"
DICT_ID_PATTERN = r"^[a-zA-Z0-9:_-]+\z"
DICT_ID_PATTERN_WITH_DOT = r"^[a-zA-Z0-9.:_-]+\z"
REQUIRED_FIELDS = ["codec", "comp_len", "count", "raw_len", "topic", "v"]

#: What topic_error can say.
TOPIC_ERRORS = ["empty", "too_long", "path_traversal", "leading_separator", "bad_character", "trailing_dot"]


def topic_error(topic: Column) -> Column:
    return (
        F.when(topic.isNull() | (topic == ""), "empty")
        .when(F.char_length(topic) > MAX_TOPIC_LENGTH, "too_long")
        .when(F.contains(topic, F.lit("..")), "path_traversal")
        .when(topic.startswith("/") | topic.startswith("\\"), "leading_separator")
        .when(~topic.rlike(TOPIC_PATTERN), "bad_character")
        .when(topic.endswith("."), "trailing_dot")
    )


def dict_id_error(dict_id: Column, allow_dot: bool = True) -> Column:
    """An empty id is valid and means an uncompressed payload."""
    pattern = DICT_ID_PATTERN_WITH_DOT if allow_dot else DICT_ID_PATTERN
    return (
        F.when(dict_id.isNull() | (dict_id == ""), None)
        .when(F.char_length(dict_id) > MAX_DICT_ID_LENGTH, "too_long")
        .when(~dict_id.rlike(pattern), "bad_character")
    )


def size_error(data: Column, limit: int = MAX_MESSAGE_BYTES) -> Column:
    """A value of exactly *limit* bytes is allowed."""
    return F.when(F.octet_length(data) > limit, "too_large")


def validate_topic(df: DataFrame, topic: str = "topic", error: str = "error") -> DataFrame:
    return df.withColumn(error, topic_error(F.col(topic)))


def validate_dict_id(
    df: DataFrame, dict_id: str = "dict_id", error: str = "error", allow_dot: bool = True
) -> DataFrame:
    return df.withColumn(error, dict_id_error(F.col(dict_id), allow_dot))


def validate_sizes(
    df: DataFrame, msg: str | None = "msg", batch: str | None = None, error: str = "error", *,
    msg_bytes: int = MAX_MESSAGE_BYTES, batch_bytes: int = MAX_BATCH_BYTES,
) -> DataFrame:
    """Check a message column, a batch payload column, or both, against the usual limits or lower ones."""
    checks = []
    if msg:
        checks.append(F.when(size_error(F.col(msg), msg_bytes).isNotNull(), "message_too_large"))
    if batch:
        checks.append(F.when(size_error(F.col(batch), batch_bytes).isNotNull(), "batch_too_large"))
    if not checks:
        raise ValueError("name a message or a batch column")
    return df.withColumn(error, F.coalesce(*checks))


def validate_header(
    df: DataFrame, header: str = "header", error: str = "error", allow_dot: bool = True
) -> DataFrame:
    """Add the first failing rule of a frame header given as JSON text.

    Integers must be JSON integers that fit 64 bits: 5 is one, 5.0, "5" and true are not.

    Parsing, taking values out and judging them are projections of their own, so that nothing is worked out twice.
    """
    value = lambda name: F.element_at("_fields", F.lit(name))
    kinds = {f"_kind_{n}": F.coalesce(F.schema_of_variant(value(n)), F.lit("VOID")) for n in (*REQUIRED_FIELDS, "dict_id")}
    texts = {f"_{n}": F.try_variant_get(value(n), "$", "string") for n in ("topic", "dict_id")}
    numbers = {f"_{n}": F.try_variant_get(value(n), "$", "bigint") for n in ("count", "raw_len", "comp_len")}
    version = {"_v": F.try_variant_get(value("v"), "$", "double")}
    kind = lambda name: F.col(f"_kind_{name}")
    whole = lambda name, least: (kind(name) == "BIGINT") & (F.col(f"_{name}") >= least)
    absent = F.array_except(F.array(*map(F.lit, REQUIRED_FIELDS)), F.map_keys("_fields"))
    rows = df.withColumn("_fields", F.from_json(header, "map<string,variant>"))
    rows = rows.withColumns({**kinds, **texts, **numbers, **version})
    rows = rows.withColumns({
        "_absent": F.array_join(absent, ","), "_bad_topic": topic_error(F.col("_topic")),
        "_bad_dict_id": dict_id_error(F.col("_dict_id"), allow_dot)})
    rows = rows.withColumn(
        error,
        F.when(F.col("_fields").isNull(), "not_an_object")
        .when(F.col("_absent") != "", F.concat(F.lit("missing:"), "_absent"))
        .when(~kind("v").rlike("^(BIGINT|DECIMAL|DOUBLE)") | (F.col("_v") != 1), "version")
        .when(~kind("topic").isin("STRING", "VOID"), "topic_type")
        .when(F.col("_bad_topic").isNotNull(), F.concat(F.lit("topic_"), "_bad_topic"))
        .when(~whole("count", 1), "count")
        .when(~whole("raw_len", 0), "raw_len")
        .when(~whole("comp_len", 0), "comp_len")
        .when(~kind("dict_id").isin("STRING", "VOID"), "dict_id_type")
        .when(F.col("_bad_dict_id").isNotNull(), F.concat(F.lit("dict_id_"), "_bad_dict_id")),
    )
    return rows.select(*[c for c in df.columns if c != error], error)


def quarantine(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Split into valid rows, without the error column, and rejected rows that keep their reason."""
    return df.filter(F.col(error).isNull()).drop(error), df.filter(F.col(error).isNotNull())


def quarantine_counts(df: DataFrame, error: str = "error") -> DataFrame:
    """Rows per outcome, ``valid`` for those without an error."""
    return df.groupBy(F.coalesce(F.col(error), F.lit("valid")).alias("outcome")).agg(F.count(F.lit(1)).alias("frames"))


def observe_outcomes(df: DataFrame, kinds: list[str], error: str = "error") -> tuple[DataFrame, Observation]:
    """Count the outcomes of rows while they are written: no pass of its own.

    *kinds* are the errors that may occur; any others count as ``other``. ``outcome_counts`` gives the numbers after the
    first action on the frame. On a stream they come with every micro-batch, to a listener or in the query's progress.
    """
    seen = Observation("outcomes")
    value = F.col(error)
    counts = [F.count_if(value.isNull()).alias("valid"), *[F.count_if(value == k).alias(k) for k in kinds],
              F.count_if(value.isNotNull() & ~value.isin(kinds)).alias("other")]
    return (df.observe("outcomes", *counts) if df.isStreaming else df.observe(seen, *counts)), seen


def outcome_counts(spark: SparkSession, seen: Observation) -> DataFrame:
    """Rows per outcome that occurred, as ``quarantine_counts`` has them."""
    rows = [(k, n) for k, n in seen.get.items() if n]
    return spark.createDataFrame(rows, "outcome string, frames long")
