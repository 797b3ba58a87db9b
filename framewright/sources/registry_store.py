"""Dictionary index files and registry snapshots."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions.scalars import dict_file_name
from ..schemas import DICT_INDEX_ENTRY, REGISTRY
from .stores import ARROW_SCHEMES, arrow_store, create_once, names_in, read_small, remove, scheme_of

INDEX_FILE = "dict_index.json"


def read_dict_index(spark: SparkSession, directory: str) -> DataFrame:
    """Entries of an index file with the bytes of their dictionary; dict_bytes is null where the file is missing.

    The stored identifier is kept. Files are matched by name inside *directory*, as index paths may be relative.
    """
    root = directory.rstrip("/")
    entries = index_entries(spark.read.text(f"{root}/{INDEX_FILE}", wholetext=True))
    name = lambda c: F.regexp_extract(c, r"([^/]+)\z", 1)
    files = spark.read.format("binaryFile").load(root).select(
        name(F.col("path")).alias("_file"), F.col("content").alias("dict_bytes"))
    return entries.withColumn("_file", name(F.col("path"))).join(files, "_file", "left").drop("_file")


def index_entries(text: DataFrame, value: str = "value") -> DataFrame:
    """Entries of index texts, one row per topic."""
    entries = F.from_json(value, f"map<string,struct<{_fields()}>>")
    return text.select(F.explode(entries).alias("topic", "entry")).select("topic", "entry.*")


def _fields() -> str:
    return ", ".join(f"{n}: {t}" for n, t in (f.split() for f in DICT_INDEX_ENTRY.split(", ")))


def index_report(index: DataFrame) -> DataFrame:
    """How many entries were loaded and how many had no readable file."""
    return index.agg(
        F.count("dict_bytes").alias("loaded"), F.count_if(F.col("dict_bytes").isNull()).alias("missing"))


def index_to_registry(index: DataFrame) -> DataFrame:
    """Registry rows from the loaded entries of an index, all active; a missing version counts as 0."""
    rows = index.filter(F.col("dict_bytes").isNotNull())
    return rows.select(
        "topic", F.coalesce("version", F.lit(0)).alias("version"), "dict_id", "dict_bytes",
        F.coalesce("created_at", F.lit(0.0)).alias("created_at"), F.lit(None).cast("double").alias("retired_at"))


def index_json(active: DataFrame, directory: str = ".") -> DataFrame:
    """One row with the index text. The format is one JSON object, so it holds one short entry per topic."""
    path = F.concat(F.lit(directory.rstrip("/") + "/"), dict_file_name(F.col("topic"), F.col("version")))
    entry = F.struct(
        "dict_id", path.alias("path"), F.octet_length("dict_bytes").alias("size"), "version", "created_at")
    entries = F.array_sort(F.collect_list(F.struct("topic", entry.alias("entry"))))
    return active.agg(F.to_json(F.map_from_entries(entries)).alias("value"))


def write_dict_index(active: DataFrame, path: str, directory: str = ".") -> None:
    """Write the index text as a one-line file below *path*."""
    index_json(active, directory).coalesce(1).write.mode("overwrite").text(path)


class DictFiles(DataSource):
    """Writes dictionaries as files and, once all of them are there, their entries into the index of the directory.

    Tasks write the files and tell their entries; the commit merges these into the index, one JSON object by its format.
    An aborted job leaves no entry, and takes its files back.
    """

    @classmethod
    def name(cls) -> str:
        return "dict_files"

    def writer(self, schema: T.StructType, overwrite: bool) -> DictWriter:
        return DictWriter(self.options["path"])


@dataclass(frozen=True)
class Written(WriterCommitMessage):
    entries: dict[str, dict]


class DictWriter(DataSourceArrowWriter):
    def __init__(self, directory: str) -> None:
        self.directory = directory

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, root = arrow_store(self.directory)
        system.create_dir(root)
        entries: dict[str, dict] = {}
        for batch in batches:
            for row in batch.to_pylist():
                content, topic, name = row.pop("dict_bytes"), row.pop("topic"), row.pop("name")
                # a repeated task writes the same file again
                with system.open_output_stream(f"{root}/{name}") as file:
                    file.write(content)
                entries[topic] = {"dict_id": row["dict_id"], "path": f"{self.directory}/{name}", "size": len(content),
                                  "version": row["version"], "created_at": row["created_at"]}
        return Written({t: {k: v for k, v in e.items() if v is not None} for t, e in entries.items()})

    def commit(self, messages: list[Written | None]) -> None:
        system, root = arrow_store(self.directory)
        entries: dict[str, dict] = {}
        if system.get_file_info(f"{root}/{INDEX_FILE}").is_file:
            with system.open_input_stream(f"{root}/{INDEX_FILE}") as file:
                entries = json.loads(file.read())
        for message in messages:
            entries |= message.entries if message else {}
        # readers see the old index or the new one
        fresh = f"{root}/.{uuid.uuid4().hex}"
        with system.open_output_stream(fresh) as file:
            file.write(json.dumps(dict(sorted(entries.items())), separators=(",", ":")).encode())
        system.move(fresh, f"{root}/{INDEX_FILE}")

    def abort(self, messages: list[Written | None]) -> None:
        system, root = arrow_store(self.directory)
        known = set()
        if system.get_file_info(f"{root}/{INDEX_FILE}").is_file:
            with system.open_input_stream(f"{root}/{INDEX_FILE}") as file:
                known = {e["path"].rsplit("/", 1)[-1] for e in json.loads(file.read()).values()}
        for message in messages:
            for entry in message.entries.values() if message else ():
                name = entry["path"].rsplit("/", 1)[-1]
                # a file that the index names had the same name before, and keeps it
                if name not in known and system.get_file_info(f"{root}/{name}").is_file:
                    system.delete_file(f"{root}/{name}")


def write_dict_files(active: DataFrame, directory: str) -> DataFrame:
    """Write the dictionaries of *active* (one row per topic) and add them to the index in *directory*.

    Files are named by topic and version; topics that the index already has are replaced in it, others stay. Tasks write
    the files, and the index comes last, so a reader never finds a name without a file. One job may write to a directory
    at a time. Needs a file system that Arrow opens. Returns the entries that are in the index now.
    """
    spark, root = active.sparkSession, directory.rstrip("/")
    if scheme_of(root) not in ARROW_SCHEMES:
        raise ValueError(f"dictionaries can't be written to {root}: Arrow doesn't open it")
    spark.dataSource.register(DictFiles)
    rows = active.select("topic", dict_file_name(F.col("topic"), F.col("version")).alias("name"), F.col("version").cast("long").alias("version"),
                         "dict_id", "dict_bytes", F.col("created_at").cast("double").alias("created_at"))
    rows.write.format("dict_files").mode("append").option("path", root).save()
    return read_dict_index(spark, root)


# Snapshots: a registry changes by writing a new directory and then naming it in the next numbered pointer.

POINTER = re.compile(r"(\d{12})")


class MovedOn(RuntimeError):
    """Another snapshot was published since the one that a change was based on."""


def publish_snapshot(registry: DataFrame, root: str, based_on: str | None = None) -> str:
    """Write a registry snapshot, then make it the current one. Readers see the old or the new one, never a mix.

    Pointers have numbers, and a number is given once: of two publishers that look at the same moment one gets it. With
    *based_on*, the name of the snapshot that was changed, the other one raises ``MovedOn`` and the change has to be made
    again, as ``change_registry`` does; without, it takes the next number.
    """
    root = root.rstrip("/")
    spark, name = registry.sparkSession, uuid.uuid4().hex
    registry.write.parquet(f"{root}/snapshots/{name}")
    while True:
        last = max(_pointers(spark, root), default=0)
        now = read_small(spark, _pointer(root, last)) if last else None
        if based_on is not None and now != based_on:
            remove(spark, f"{root}/snapshots/{name}")
            raise MovedOn(f"{now} is current, not {based_on}")
        if create_once(spark, _pointer(root, last + 1), name.encode()):
            return name


def change_registry(
    spark: SparkSession, root: str, change: Callable[[DataFrame], DataFrame], attempts: int = 20
) -> str:
    """Publish *change* of the current registry; if another one is published meanwhile, change that one instead."""
    for _ in range(attempts):
        before = current_name(spark, root)
        try:
            return publish_snapshot(change(current_registry(spark, root, before)), root, based_on=before)
        except MovedOn:
            continue
    raise MovedOn(f"{attempts} changes of {root} were overtaken")


def expire_snapshots(spark: SparkSession, root: str, keep: int = 10) -> list[str]:
    """Remove all but the last *keep* published snapshots, with their pointers; their names.

    Readers that still hold an older one lose it.
    """
    root = root.rstrip("/")
    old = sorted(_pointers(spark, root))[:-max(keep, 1)]
    names = [read_small(spark, _pointer(root, n)) for n in old]
    for number, name in zip(old, names, strict=True):
        remove(spark, _pointer(root, number))
        remove(spark, f"{root}/snapshots/{name}")
    return names


def _pointer(root: str, number: int) -> str:
    return f"{root}/pointers/{number:012d}"


def _pointers(spark: SparkSession, root: str) -> list[int]:
    return [int(n) for n in names_in(spark, f"{root}/pointers") if POINTER.fullmatch(n)]


def current_name(spark: SparkSession, root: str) -> str:
    """Name of the snapshot of the newest pointer."""
    root = root.rstrip("/")
    return read_small(spark, _pointer(root, max(_pointers(spark, root))))


def current_registry(spark: SparkSession, root: str, name: str | None = None) -> DataFrame:
    """The registry of the newest pointer, or of the snapshot of that name."""
    root = root.rstrip("/")
    return spark.read.schema(REGISTRY).parquet(f"{root}/snapshots/{name or current_name(spark, root)}")
