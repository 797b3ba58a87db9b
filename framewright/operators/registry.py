"""Dictionary versions per topic: sampling, readiness, publishing, look-up and clean-up.

A registry is a table (topic, version, dict_id, dict_bytes, created_at, retired_at); times are epoch seconds and a row
without retired_at is active.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.scalars import dict_id as make_dict_id
from ..session import BROADCAST_ROWS, broadcast_if_small, join_null_safe, scratch_table
from .ordered import CHUNK_ROWS, group_sizes, latest, order_rows, running_sums

#: Times *max_samples* messages that one task puts in order; more are first spread over sub-groups of that size.
SAMPLE_SPREAD = 64
#: Halvings by which a cut-off may shorten a topic, and the accuracy of the quantiles that it is taken from.
SAMPLE_HALVINGS, SAMPLE_ACCURACY = 12, 100_000
#: Versions of one topic up to which looking through all of them beats putting the batches in order.
LOOKUP_VERSIONS = 64


# Samples


def sample_window(
    messages: DataFrame, max_samples: int = 10_000, max_bytes: int = 2 * 1024 * 1024, *, topic: str = "topic",
    order: Sequence[str] = ("ts", "seq"), msg: str = "msg",
) -> DataFrame:
    """The newest messages per topic that fit both caps; empty messages do not count.

    One pass counts the messages of every topic and takes quantiles of their time; of a large topic only those since a
    cut-off are moved at all. They are spread over sub-groups that each keep their newest *max_samples*, as often as it
    takes, so that what meets in one task is bounded however large the topic is and however its times are spread.
    """
    newest = [F.col(c).desc() for c in order]
    kept, largest = _since_cutoff(messages.filter(F.octet_length(msg) > 0), max_samples, topic, order[0])
    level = 0
    while largest > SAMPLE_SPREAD * max_samples:
        groups, level = math.ceil(largest / (SAMPLE_SPREAD * max_samples)), level + 1
        spread = F.pmod(F.xxhash64(*order, F.lit(level)), F.lit(groups))
        within = Window.partitionBy(topic, "_spread").orderBy(*newest)
        kept = kept.withColumn("_spread", spread).withColumn("_rank", F.row_number().over(within))
        kept, largest = kept.filter(F.col("_rank") <= max_samples).drop("_spread"), groups * max_samples
    whole = Window.partitionBy(topic).orderBy(*newest)
    kept = kept.withColumn("_rank", F.row_number().over(whole)).filter(F.col("_rank") <= max_samples)
    size = F.sum(F.octet_length(msg).cast("long")).over(whole.rowsBetween(Window.unboundedPreceding, 0))
    return kept.withColumn("_bytes", size).filter(F.col("_bytes") <= max_bytes).drop("_rank", "_bytes")


def _since_cutoff(messages: DataFrame, wanted: int, topic: str, at: str) -> tuple[DataFrame, int]:
    """Drop messages that are older than the newest *wanted* of their topic can be; also the most that a topic has left.

    The cut-off is the quantile that leaves the smallest power-of-two share with *wanted* messages for certain, its error
    included. Outliers in time do not move it, and a time that is null counts as oldest.
    """
    kind = messages.schema[at].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        value = F.col(at).cast("timestamp").cast("double")
    elif isinstance(kind, T.NumericType):
        value = F.col(at).cast("double")
    else:
        return messages, group_sizes(messages, [topic]).largest
    shares = [1 - 2.0 ** -k for k in range(1, SAMPLE_HALVINGS + 1)]
    stats = messages.groupBy(topic).agg(
        F.count(F.lit(1)).alias("_all"), F.count(value).alias("_n"), F.percentile_approx(value, shares, SAMPLE_ACCURACY).alias("_q"))
    sure = F.col("_n") / (wanted + 2 + F.col("_n") * (2.0 / SAMPLE_ACCURACY))
    halvings = F.least(F.floor(F.log2(F.greatest(sure, F.lit(1.0)))), F.lit(SAMPLE_HALVINGS)).cast("int")
    stats = stats.withColumn("_halvings", halvings)
    stats = scratch_table(stats.select(
        topic, F.when(F.col("_halvings") > 0, F.element_at("_q", F.greatest("_halvings", F.lit(1)))).alias("_cut"),
        F.when(F.col("_halvings") > 0, F.col("_n") / F.pow(F.lit(2.0), "_halvings") + F.col("_n") * (2.0 / SAMPLE_ACCURACY))
        .otherwise(F.col("_all")).alias("_left")), "cutoffs")
    largest = stats.agg(F.coalesce(F.max("_left"), F.lit(0.0))).first()[0]
    recent = join_null_safe(messages, broadcast_if_small(stats), [topic])
    recent = recent.filter(F.col("_cut").isNull() | (value >= F.col("_cut")))
    return recent.drop("_cut", "_left"), math.ceil(largest)


def sample_stats(
    messages: DataFrame, samples: DataFrame, dict_size: int = 8192, *, topic: str = "topic", msg: str = "msg"
) -> DataFrame:
    """Per topic: samples kept, their bytes, messages pushed, messages evicted and the readiness ratio."""
    pushed = messages.filter(F.octet_length(msg) > 0).groupBy(topic).agg(F.count(F.lit(1)).alias("push_count"))
    kept = _sample_totals(samples, topic, msg)
    return join_null_safe(pushed, kept, [topic], "left").fillna(0, ["sample_count", "total_bytes"]).select(
        topic, "sample_count", "total_bytes", "push_count",
        (F.col("push_count") - F.col("sample_count")).alias("eviction_count"),
        _ready_ratio(dict_size).alias("ready_ratio"))


def _sample_totals(samples: DataFrame, topic: str, msg: str) -> DataFrame:
    return samples.groupBy(topic).agg(
        F.count(F.lit(1)).alias("sample_count"), F.sum(F.octet_length(msg).cast("long")).alias("total_bytes"))


def _ready_ratio(dict_size: int) -> Column:
    return F.round(F.col("total_bytes") / F.lit(dict_size * 200), 3)


def training_readiness(
    samples: DataFrame, dict_size: int = 8192, min_samples: int = 10, *, topic: str = "topic", msg: str = "msg"
) -> DataFrame:
    """Whether a topic has enough to train: 200 bytes of samples per dictionary byte, and *min_samples*."""
    return _sample_totals(samples, topic, msg).withColumns({
        "ready_ratio": _ready_ratio(dict_size),
        "enough_bytes": F.col("total_bytes") >= dict_size * 200,
        "enough_samples": F.col("sample_count") >= min_samples,
    })


def budget_prefix(
    files: DataFrame, max_bytes: int, *, topic: str = "topic", name: str = "path", size: str = "length",
    chunk_rows: int = CHUNK_ROWS, strategy: str = "auto",
) -> DataFrame:
    """Whole files in name order until their bytes, one more per file, reach the budget; the crossing file is kept."""
    rows = order_rows(files, [topic], [name], chunk_rows=chunk_rows, strategy=strategy)
    cost = F.col(size).cast("long") + 1
    rows = running_sums(rows, budget_bytes=cost)
    return rows.result().filter(F.col("budget_bytes") - (F.col(size) + 1) < max_bytes)


# Versions


def active_versions(registry: DataFrame) -> DataFrame:
    """The newest version per topic that is not retired."""
    fields = [c for c in registry.columns if c != "topic"]
    newest = F.max_by(F.struct(*fields), "version")
    return (
        registry.filter(F.col("retired_at").isNull()).groupBy("topic").agg(newest.alias("_row"))
        .select("topic", *[F.col(f"_row.{c}").alias(c) for c in fields])
    )


def publish_versions(registry: DataFrame, trained: DataFrame, now: float | Column) -> DataFrame:
    """The registry after *trained* (topic, dict_bytes) went live: next version active, active ones retired *now*."""
    now = now if isinstance(now, Column) else F.lit(float(now))
    latest_version = registry.groupBy("topic").agg(F.max("version").alias("_last"))
    fresh = trained.select("topic", "dict_bytes")
    fresh = join_null_safe(fresh, latest_version, ["topic"], "left").withColumn(
        "version", (F.greatest(F.coalesce(F.col("_last"), F.lit(0)), F.lit(0)) + 1).cast("int"))
    fresh = fresh.select(
        "topic", "version", make_dict_id(F.col("topic"), F.col("version"), F.col("dict_bytes")).alias("dict_id"),
        "dict_bytes", now.cast("double").alias("created_at"), F.lit(None).cast("double").alias("retired_at"))
    replaced = trained.select("topic").distinct().withColumn("_replaced", F.lit(True))
    old = join_null_safe(registry, broadcast_if_small(replaced), ["topic"], "left")
    retired = F.when(F.col("retired_at").isNull() & F.col("_replaced").isNotNull(), now).otherwise(F.col("retired_at"))
    return old.withColumn("retired_at", retired).drop("_replaced").unionByName(fresh)


def _kept(now: float, ttl: float) -> Column:
    return F.col("retired_at").isNull() | (F.lit(float(now)) - F.col("retired_at") < ttl)


def gc_versions(registry: DataFrame, now: float, ttl: float = 300.0) -> DataFrame:
    """Drop versions that have been retired for *ttl* seconds or longer."""
    return registry.filter(_kept(now, ttl))


def gc_report(registry: DataFrame, now: float, ttl: float = 300.0) -> DataFrame:
    """Versions removed and remaining per topic."""
    kept = _kept(now, ttl)
    return registry.groupBy("topic").agg(
        F.count_if(~kept).alias("removed"), F.count_if(kept).alias("remaining"))


def registry_stats(
    registry: DataFrame, samples: DataFrame | None = None, monitor: DataFrame | None = None,
    running: DataFrame | None = None,
) -> DataFrame:
    """Per topic: active version and its size, version counts, training in progress, sample and monitor figures.

    *samples* comes from ``sample_stats``, *monitor* from ``monitor_stats`` and *running* is a table of topics.
    """
    counts = registry.groupBy("topic").agg(
        F.count(F.lit(1)).alias("total_versions"), F.count("retired_at").alias("retired_versions"))
    active = active_versions(registry.withColumn("active_dict_size", F.octet_length("dict_bytes").cast("long")).drop(
        "dict_bytes")).select(
        "topic", F.col("dict_id").alias("active_dict_id"), F.col("version").alias("active_version"), "active_dict_size")
    stats = join_null_safe(counts, active, ["topic"], "left").fillna(0, ["active_dict_size"])
    for extra in (samples, monitor):
        if extra is not None:
            stats = join_null_safe(stats, extra, ["topic"], "left")
    if running is not None:
        marked = running.select("topic").distinct().withColumn("retrain_in_progress", F.lit(True))
        stats = join_null_safe(stats, marked, ["topic"], "left").fillna(False, ["retrain_in_progress"])
    return stats


def registry_totals(registry: DataFrame) -> DataFrame:
    """Number of topics and versions overall."""
    per_topic = registry.groupBy("topic").agg(F.count(F.lit(1)).alias("versions"))
    return per_topic.agg(
        F.count(F.lit(1)).alias("total_topics"), F.coalesce(F.sum("versions"), F.lit(0)).alias("total_versions"))


def retrain_candidates(events: DataFrame, readiness: DataFrame, running: DataFrame | None = None) -> DataFrame:
    """Topics with a drift event and what follows: ``retrain``, or why not.

    *events* has topic and event_type, *readiness* comes from ``training_readiness``.
    """
    drifted = events.filter(F.col("event_type") == "drift_detected").groupBy("topic").agg(
        F.count(F.lit(1)).alias("drift_events"))
    rows = join_null_safe(drifted, readiness.select("topic", "enough_bytes", "enough_samples"), ["topic"], "left")
    if running is None:
        rows = rows.withColumn("_running", F.lit(None).cast("boolean"))
    else:
        marked = running.select("topic").distinct().withColumn("_running", F.lit(True))
        rows = join_null_safe(rows, marked, ["topic"], "left")
    return rows.select(
        "topic", "drift_events",
        F.when(F.col("_running"), "already_running")
        .when(~F.coalesce(F.col("enough_bytes"), F.lit(False)), "not_enough_bytes")
        .when(~F.coalesce(F.col("enough_samples"), F.lit(False)), "too_few_samples")
        .otherwise("retrain").alias("decision"))


# Look-up


def attach_active_dict(batches: DataFrame, registry: DataFrame, with_bytes: bool = True) -> DataFrame:
    """Add the active dictionary of the topic; without one, dict_id is empty."""
    columns = ["topic", "dict_id", *(["dict_bytes"] if with_bytes else [])]
    active = active_versions(registry.select(*columns, "version", "retired_at")).select(*columns)
    active = broadcast_if_small(active, "dict_bytes" if with_bytes else None)
    return batches.join(active, "topic", "left").fillna("", ["dict_id"])


def attach_dict_by_id(frames: DataFrame, registry: DataFrame) -> DataFrame:
    """Add dict_bytes of any version, retired ones included, and dict_known; an empty dict_id needs none."""
    versions = registry.select("dict_id", "dict_bytes").filter(F.col("dict_id") != "").dropDuplicates(["dict_id"])
    versions = broadcast_if_small(versions, "dict_bytes")
    known = (F.coalesce(F.col("dict_id"), F.lit("")) == "") | F.col("dict_bytes").isNotNull()
    return frames.join(versions, "dict_id", "left").withColumn("dict_known", known)


def unknown_dicts(frames: DataFrame, registry: DataFrame) -> DataFrame:
    """Frames per dictionary id that no version has."""
    used = frames.filter(F.col("dict_id") != "").groupBy("dict_id").agg(F.count(F.lit(1)).alias("frames"))
    return used.join(registry.select("dict_id"), "dict_id", "left_anti")


def dict_as_of(
    batches: DataFrame, registry: DataFrame, at: str = "t0", *, seq: str = "batch_id", chunk_rows: int = CHUNK_ROWS,
    strategy: str = "auto",
) -> DataFrame:
    """Add the version in force at the time of each batch: created_at <= t < end, as dict_id and version.

    The end of a version is its retirement or the creation of the next one; a version without a creation date is never in
    force, and at no time no version is. A registry of checked size with few versions
    per topic is broadcast as one sorted array per topic; otherwise versions and batches are put into one order and the
    last version is taken. strategy: ``lookup``, ``scan`` or ``auto``.
    """
    following = F.lead("created_at").over(Window.partitionBy("topic").orderBy("created_at", "version"))
    spans = registry.filter(F.col("created_at").isNotNull()).select("topic", "version", "dict_id", "created_at", "retired_at").withColumn(
        "_end", F.least(F.col("retired_at"), following))
    if strategy == "auto":
        sizes = group_sizes(registry, ["topic"])
        small = sizes.rows <= BROADCAST_ROWS and sizes.largest <= LOOKUP_VERSIONS
        strategy = "lookup" if small else "scan"
    if strategy == "lookup":
        span = F.struct(F.col("created_at").alias("start"), "version", "dict_id", F.col("_end").alias("end"))
        per_topic = spans.groupBy("topic").agg(F.array_sort(F.collect_list(span)).alias("_spans"))
        t = F.col(at)
        rows = batches.join(broadcast_if_small(per_topic), "topic", "left")
        hit = F.filter("_spans", lambda s: (s["start"] <= t) & (s["end"].isNull() | (t < s["end"])))
        rows = rows.withColumn("_hit", F.try_element_at(hit, F.lit(-1)))
        return rows.withColumns({
            "dict_id": F.coalesce(F.col("_hit.dict_id"), F.lit("")), "version": F.col("_hit.version"),
        }).drop("_spans", "_hit")
    mark = F.struct("version", "dict_id", F.col("_end").alias("end")).alias("_mark")
    starts = spans.select("topic", F.col("created_at").alias(at), mark, F.lit(0).alias("_kind"), F.col("version").cast("long").alias("_tie"))
    both = batches.withColumn("_kind", F.lit(1)).withColumn("_tie", F.col(seq).cast("long")).unionByName(
        starts, allowMissingColumns=True)
    rows = order_rows(both, ["topic"], [at, "_kind", "_tie"], chunk_rows=chunk_rows,
                      strategy="auto" if strategy == "scan" else strategy)
    rows = latest(rows, _hit=F.col("_mark"))
    live = F.col("_hit.end").isNull() | (F.col(at) < F.col("_hit.end"))
    return rows.result().filter(F.col("_kind") == 1).withColumns({
        "dict_id": F.coalesce(F.when(live, F.col("_hit.dict_id")), F.lit("")),
        "version": F.when(live, F.col("_hit.version")),
    }).drop("_kind", "_tie", "_mark", "_hit")
