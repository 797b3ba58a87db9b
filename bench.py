"""Time the headline queries on the given tables and print one JSON line.

BENCH_SF_DIR is the table folder, BENCH_CPUS the number of local cores. Every query is written out in full through a
no-op sink after one untimed round that starts Spark, its code generator and the Python workers.
"""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from framewright import assign_batches, build_batches, compression_report, train_dicts, train_global_dict
from framewright.plans import catalog
from framewright.session import local_session, scratch_table

HEADLINE = [
    "batch_flow", "batches_by_timer", "batch_payloads", "normalize_typed", "normalize_any_json", "header_checks",
    "payload_signatures", "frames_round_trip", "frames_compressed", "wire_table", "topic_files",
    "dictionary_as_of", "dictionary_by_id", "newest_samples", "trained_dictionaries", "published_versions",
    "ratio_average", "ratio_average_chunked", "drift_monitor", "drift_monitor_stats",
    "metrics_by_topic", "metrics_combined", "running_by_topic", "running_overall", "interval_rates", "breaker_intervals",
    "evicted_store", "unsettled_frames", "delivered_once", "queue_depths", "breaker_log", "streamed_batches",
    "wire_files_round_trip", "dictionary_files",
]


def feeds(spark: SparkSession) -> DataFrame:
    """Own messages of the shapes whose ratios are published: file metadata in three types and three cameras."""
    n = F.col("id").cast("int")
    kinds = F.array(*map(F.lit, ("txt", "csv", "json")))
    sides = F.array(*map(F.lit, ("front", "left", "right")))
    kind, side = F.element_at(kinds, n % 3 + 1), F.element_at(sides, n % 3 + 1)
    noise = lambda k, m: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(m))
    file = F.to_json(F.struct(
        kind.alias("file_type"), F.concat(F.lit("/archive/part-"), noise(1, 5000).cast("string"), F.lit("."), kind).alias("path"),
        (noise(2, 900_000) + 100).alias("size"), F.sha2(n.cast("string").cast("binary"), 256).alias("checksum"),
        (F.lit(1_704_100_000) + n * 17).cast("long").alias("timestamp")))
    box = lambda k: F.struct(
        F.element_at(F.array(*map(F.lit, ("tram", "bike", "walker", "lorry"))), (noise(k, 4) + 1).cast("int")).alias("type"),
        F.array(*[noise(10 * k + j, 1900).cast("int") for j in range(4)]).alias("bbox"), (F.lit(0.5) + noise(k + 9, 500) / 1000).alias("confidence"))
    camera = F.to_json(F.struct(
        side.alias("camera"), n.cast("long").alias("frame"), F.array(*[box(k) for k in range(1, 9)]).alias("objects"),
        (F.lit(1_704_100_000_000) + n * 33).cast("long").alias("timestamp")))
    rows = spark.range(3300).select("id", F.explode(F.array(
        F.struct(F.concat(F.lit("files."), kind).alias("topic"), file.alias("msg")),
        F.struct(F.concat(F.lit("camera."), side).alias("topic"), camera.alias("msg")))).alias("m"))
    return rows.select("m.topic", F.timestamp_seconds(F.col("id") * 10).alias("ts"), F.col("id").alias("seq"), "m.msg")


#: Published ratios of compressed to raw bytes, 100 messages per topic, zlib; those of cameras are bytes by raw bytes.
PUBLISHED = {
    "files.txt": {"no_dict": 0.2473, "global_dict": 0.1599, "topic_dict": 0.1599},
    "files.csv": {"no_dict": 0.2484, "global_dict": 0.2450, "topic_dict": 0.1604},
    "files.json": {"no_dict": 0.2425, "global_dict": 0.2387, "topic_dict": 0.1583},
    "camera.front": {"no_dict": 0.4216, "global_dict": 0.2450, "topic_dict": 0.2450},
    "camera.left": {"no_dict": 0.4203, "global_dict": 0.2775, "topic_dict": 0.2456},
    "camera.right": {"no_dict": 0.4159, "global_dict": 0.2778, "topic_dict": 0.2444},
}


def ratios(spark: SparkSession) -> dict[str, dict[str, float]]:
    """Compressed / raw per topic and method: 100 messages, of files as one batch, of cameras each on its own; the
    dictionaries come from 1000 others."""
    messages = scratch_table(feeds(spark), "feeds")
    first, rest = messages.filter("seq < 3000"), messages.filter("seq >= 3000")
    trained = scratch_table(train_dicts(first, 8192, method="prefix"), "trained")
    shared = scratch_table(train_global_dict(first, 8192, method="prefix"), "shared")
    found: dict[str, dict[str, float]] = {}
    for feed, size in (("files.", 100), ("camera.", 1)):
        batches = build_batches(assign_batches(rest.filter(F.col("topic").startswith(feed)), size, 10 ** 9))
        report = compression_report(batches, trained, shared, codec="zlib")
        for row in report.filter("topic <> '*' AND method <> 'raw'").collect():
            found.setdefault(row.topic, {})[row.method] = round(row.ratio, 4)
    return found


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(cores) if cores.isdigit() else 8, **{"spark.ui.showConsoleProgress": "false"})
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")

    def run(name: str) -> float:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    for name in ("batch_flow", "normalize_any_json"):
        run(name)
    times = {name: run(name) for name in names}
    messages = spark.read.parquet(f"{root}/events.parquet").count()
    scale = re.search(r"sf([0-9.]+)", root)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(scale.group(1)) if scale else None, "cores": cores,
        "messages_per_sec": {n: round(messages / times[n]) for n in ("batch_flow", "frames_round_trip") if n in times},
        "ratios": ratios(spark), "published_ratios": PUBLISHED,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
