"""Wire frames: 4-byte big-endian header length, JSON header, payload."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.checks import validate_header
from ..schemas import FRAME_HEADER
from ..session import scratch_table
from .stores import ARROW_SCHEMES, open_input, scheme_of

# Header fields in wire order.
HEADER_FIELDS = ["v", "topic", "codec", "level", "dict_id", "schema_id", "count", "raw_len", "comp_len", "t0", "t1"]
SIGNATURE_FIELDS = ["hmac", "hmac_algo"]

#: Bytes of payload after which the splitter hands a batch over.
BATCH_BYTES = 32 * 1024 * 1024
#: Bytes of a wire file that one task searches for frames, and of payloads that it reads afterwards.
RANGE_BYTES = 64 * 1024 * 1024
#: Bytes that opening a file counts for, where small files are dealt to tasks.
OPEN_BYTES = 256 * 1024
#: Bytes read beyond a range, for the header of its last frame; a longer one is read by itself.
BEYOND_BYTES = 64 * 1024
#: A header of this many bytes or more is not usable.
MOST_HEADER_BYTES = 1 << 24



# A length below MOST_HEADER_BYTES, and the start of a JSON object behind it; matches may overlap.
_HEADER = re.compile(rb"(?=(\x00[\x00-\xff]{3})[ \t\r\n]*\{)")


def frame_header(columns: list[str], hmac_name: str = "hmac") -> Column:
    """Header JSON from the columns of a frame; signature fields only where present."""
    fields = [c for c in HEADER_FIELDS if c in columns]
    fields += [c for c in SIGNATURE_FIELDS if c in columns]
    return F.to_json(F.struct(*[F.col(c).alias(hmac_name if c == "hmac" else c) for c in fields]))


def encode_frames(frames: DataFrame, payload: str = "payload", header: str | None = None, hmac_name: str = "hmac") -> DataFrame:
    """Add ``frame``, the wire bytes. The header is built from the columns unless *header* names a JSON column."""
    text = F.col(header) if header else frame_header(frames.columns, hmac_name)
    size = F.unhex(F.lpad(F.hex(F.octet_length(text)), 8, "0"))
    return frames.withColumn("frame", F.concat(size, F.encode(text, "utf-8"), F.col(payload)))


def read_frames(spark: SparkSession, path: str, hmac_name: str = "hmac", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Frames of wire files: path, pos, header (JSON text), payload, bytes_left, error and the header fields as columns.

    Files are read in ranges of *range_bytes*, many ranges of a file at a time. Where a frame starts depends on all frames
    before it, which a range doesn't know: it tests every place that may be a header and links each to the place behind its
    payload. Joining the ranges' chains from the start of the file keeps the frames and drops what only looks like one, such
    as a frame inside a payload. Payloads are read last, in ranges too, so a task never holds more than a range and a frame.

    What cannot be read is a row with an error: ``truncated`` where a frame goes on behind the end of its file, or a header
    that is not usable, as one of MOST_HEADER_BYTES or more. It ends its file, and bytes_left counts the bytes from there
    on. An empty file has no rows.

    Ranges need a file system that Arrow opens (ARROW_SCHEMES). In any other one, Spark loads each file as a value,
    whatever its size, so files there must stay below 2 GiB.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").collect()
    ranged = [(f.path, f.length) for f in files if scheme_of(f.path) in ARROW_SCHEMES]
    if len(ranged) < len(files):
        return split_frames(spark.read.format("binaryFile").load(path).select("path", "content"), "path", "content", hmac_name)
    spark.dataSource.register(WireSource)
    source = spark.read.format("wire_frames").option("files", json.dumps(ranged)).option("range_bytes", range_bytes)
    found = scratch_table(source.load(), "wire-frames")
    return _judged(_payloads(_chained(found, range_bytes), range_bytes), hmac_name)


@dataclass(frozen=True)
class WireRange(InputPartition):
    """Bytes *begin* to *end* of a file; frames that start there belong to it."""

    path: str
    begin: int
    end: int
    length: int


@dataclass(frozen=True)
class WireFiles(InputPartition):
    """Whole files that are together no longer than a range, opening them included; *begin* to *end* counts their bytes."""

    files: tuple[tuple[str, int], ...]
    begin: int
    end: int


class WireSource(DataSource):
    """Places of wire files that may be frames, with the chains that they form inside their range.

    A chain is a run of places each of which starts behind the payload of the one before; `chain` is its first place and
    `idx` counts from there. `next` is the place behind the payload. A payload that goes on behind the end of the file has
    no size, and `left` counts the bytes from its frame on. Every file has a row with chain -1, whose next place is 0.
    """

    @classmethod
    def name(cls) -> str:
        return "wire_frames"

    def schema(self) -> str:
        return "path STRING, at BIGINT, header STRING, start BIGINT, size BIGINT, left BIGINT, next BIGINT, chain BIGINT, idx BIGINT, ends BOOLEAN, length BIGINT"

    def reader(self, schema: T.StructType) -> WireReader:
        return WireReader(json.loads(self.options["files"]), int(self.options["range_bytes"]))


class WireReader(DataSourceReader):
    def __init__(self, files: list[tuple[str, int]], range_bytes: int) -> None:
        self.files, self.range_bytes = files, range_bytes

    def partitions(self) -> list[WireRange | WireFiles]:
        """Ranges of large files, and small files many at a time: a task per file would cost more than its bytes."""
        parts: list[WireRange | WireFiles] = []
        small: list[tuple[str, int]] = []
        held = 0
        for path, length in self.files:
            if length + OPEN_BYTES > self.range_bytes:
                parts += [WireRange(path, begin, min(begin + self.range_bytes, length), length) for begin in range(0, length, self.range_bytes)]
            elif length:
                if held + length + OPEN_BYTES > self.range_bytes:
                    parts.append(WireFiles(tuple(small), 0, sum(n for _, n in small)))
                    small, held = [], 0
                small.append((path, length))
                held += length + OPEN_BYTES
        return [*parts, WireFiles(tuple(small), 0, sum(n for _, n in small))] if small else parts

    def read(self, partition: WireRange | WireFiles) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        names = ["path", "at", "header", "start", "size", "left", "next", "chain", "idx", "ends", "length"]
        kinds = [pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 6, pa.bool_(), pa.int64()]
        rows: list[tuple] = []

        def batches(least: int) -> Iterator[pa.RecordBatch]:
            while len(rows) >= least:
                part = rows[:10_000]
                del rows[:10_000]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names)

        whole = partition.files if isinstance(partition, WireFiles) else []
        for place in [WireRange(path, 0, length, length) for path, length in whole] or [partition]:
            rows += [(place.path, *row, place.length) for row in _places(place)]
            if place.begin == 0:
                rows.append((place.path, None, None, None, None, None, 0, -1, 0, True, place.length))
            yield from batches(10_000)
        yield from batches(1)


def _places(part: WireRange) -> list[tuple]:
    """Everything in a range that may be a frame: at, header, start, size, left, next, chain, idx, ends."""
    found: list[tuple] = []
    with open_input(part.path) as file:
        file.seek(part.begin)
        data = file.read(min(part.end + BEYOND_BYTES, part.length) - part.begin)
        for match in _HEADER.finditer(data):
            at = part.begin + match.start()
            if at >= part.end:
                break
            start = at + 4 + int.from_bytes(match[1], "big")
            if start > part.length:
                continue
            text = data[at + 4 - part.begin:start - part.begin]
            if len(text) < start - at - 4:
                file.seek(at + 4)
                text = file.read(start - at - 4)
            text = text.decode("utf-8", "replace")
            size = _payload_length(text)
            if size is not None:
                cut = start + size > part.length
                found.append((at, text, start, None if cut else size, part.length - at if cut else None, part.length if cut else start + size))
    place = {row[0]: i for i, row in enumerate(found)}
    chain, idx, ends = [row[0] for row in found], [0] * len(found), [True] * len(found)
    taken = set()
    for i, row in enumerate(found):
        after = place.get(row[5])
        # of several places that lead to one, the first goes on; the others' chains end there
        if after is not None and after not in taken:
            taken.add(after)
            chain[after], idx[after], ends[i] = chain[i], idx[i] + 1, False
    return [(*row, c, k, e) for row, c, k, e in zip(found, chain, idx, ends, strict=True)]


def _chained(found: DataFrame, range_bytes: int) -> DataFrame:
    """The frames among the places, with their position; and where a file can't be followed further, a row without header."""
    ends = found.filter("ends").select("path", "chain", "idx", F.col("next").alias("exit"), "length")
    targets = found.filter("chain >= 0").select(F.col("path").alias("_path"), F.col("at").alias("_at"), F.col("chain").alias("to_chain"), F.col("idx").alias("to_idx"))
    links = ends.join(targets, (F.col("path") == F.col("_path")) & (F.col("exit") == F.col("_at")), "left").drop("_path", "_at")

    def walk(table: pa.Table) -> pa.Table:
        """Chains that are entered, from which place on, and the position of that place; chain -2 stands for a broken end."""
        link = {row.pop("chain"): row for row in table.to_pylist()}
        path, chain, since, pos, out = table.column("path")[0].as_py(), -1, 0, -1, []
        while chain is not None:
            here = link[chain]
            out.append((path, chain, since, pos, here["exit"]))
            pos += here["idx"] + 1 - since
            chain, since = here["to_chain"], here["to_idx"]
        if here["exit"] < here["length"]:
            out.append((path, -2, 0, pos, here["exit"]))
        return pa.Table.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["path", "chain", "since", "first", "exit"])

    entered = links.groupBy("path").applyInArrow(walk, "path STRING, chain BIGINT, since BIGINT, first BIGINT, exit BIGINT")
    entered = scratch_table(entered, "wire-chains")
    frames = found.filter("chain >= 0").join(entered.drop("exit"), ["path", "chain"]).filter("idx >= since").select(
        "path", (F.col("first") + F.col("idx") - F.col("since")).alias("pos"), "at", "header", "start", "size", "left")
    broken = entered.filter("chain = -2").join(found.filter("chain = -1").select("path", "length"), "path").select(
        "path", F.col("first").alias("pos"), F.col("exit").alias("at"), F.lit(None).cast("string").alias("header"),
        F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("size"), (F.col("length") - F.col("exit")).alias("left"))
    return frames.unionByName(broken)


def _payloads(frames: DataFrame, range_bytes: int) -> DataFrame:
    """Rows of ``path``, ``pos``, ``header``, ``payload`` and ``bytes_left`` from places in files."""
    names = ["path", "pos", "header", "payload", "bytes_left"]

    def read(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, name, rows, held = None, None, [], 0

        def batch() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        try:
            for table in tables:
                for row in table.to_pylist():
                    if row["path"] != name:
                        if file is not None:
                            file.close()
                        file, name = open_input(row["path"]), row["path"]
                    header, payload = row["header"], None
                    if row["size"] is not None:
                        file.seek(row["start"])
                        payload = file.read(row["size"])
                    elif header is None:
                        header = _broken_header(file, row["at"], row["left"])
                    rows.append((name, row["pos"], header, payload, row["left"]))
                    held += (row["size"] or 0) + len(header or "")
                    if held >= BATCH_BYTES:
                        yield batch()
                        rows, held = [], 0
            if rows:
                yield batch()
        finally:
            if file is not None:
                file.close()

    part = F.floor(F.col("at") / range_bytes)
    dealt = frames.repartition("path", part).sortWithinPartitions("path", "at")
    return dealt.mapInArrow(read, "path STRING, pos BIGINT, header STRING, payload BINARY, bytes_left BIGINT")


def _broken_header(file, at: int, left: int) -> str | None:
    """The text of a header that can't be used, or its beginning if it is too large; none if it is cut off."""
    file.seek(at)
    size = int.from_bytes(file.read(4), "big") if left >= 4 else left
    if 4 + size > left:
        return None
    return file.read(size if size < MOST_HEADER_BYTES else BEYOND_BYTES).decode("utf-8", "replace")


def _payload_length(text: str) -> int | None:
    """comp_len of a header, or none if the header cannot be used."""
    try:
        length = json.loads(text)["comp_len"]
    except (ValueError, TypeError, KeyError):
        return None
    return length if type(length) is int and length >= 0 else None


def split_frames(blobs: DataFrame, name: str = "path", content: str = "content", hmac_name: str = "hmac") -> DataFrame:
    """Split binary values that hold one frame after the other."""
    out = T.StructType.fromDDL("path STRING, pos BIGINT, header STRING, payload BINARY, bytes_left BIGINT")

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            for path, blob in zip(table.column(0).to_pylist(), table.column(1)):
                yield from _batches(path, memoryview(blob.as_buffer()) if blob.is_valid else memoryview(b""))

    raw = blobs.select(F.col(name).cast("string"), F.col(content)).mapInArrow(run, out)
    return _judged(raw, hmac_name)


def _judged(raw: DataFrame, hmac_name: str) -> DataFrame:
    """Header fields and errors of rows of ``path``, ``pos``, ``header``, ``payload`` and ``bytes_left``."""
    rows = parse_header(raw, hmac_name)
    cut = F.col("payload").isNull() & F.col("bytes_left").isNotNull() & (F.col("header").isNull() | F.col("error").isNull())
    return rows.withColumn("error", F.when(cut, "truncated").otherwise(F.col("error")))


def _frames(blob: memoryview) -> Iterator[tuple[str | None, bytes | None, int | None]]:
    """Header, payload and, where the value cannot be followed further, the bytes from that frame on."""
    at, end = 0, len(blob)
    while at < end:
        start = at
        at += 4 + int.from_bytes(blob[at:at + 4], "big") if at + 4 <= end else end
        if at > end or start + 4 > end:
            yield None, None, end - start
            return
        text = bytes(blob[start + 4:at]).decode("utf-8", "replace")
        length = _payload_length(text)
        if length is None or at + length > end:
            yield text, None, end - start
            return
        yield text, bytes(blob[at:at + length]), None
        at += length


def _batches(path: str, blob: memoryview) -> Iterator[pa.RecordBatch]:
    rows, first, held = [], 0, 0

    def batch() -> pa.RecordBatch:
        headers, payloads, left = zip(*rows)
        return pa.RecordBatch.from_pydict({
            "path": pa.array([path] * len(rows), pa.string()), "pos": pa.array(range(first, first + len(rows)), pa.int64()),
            "header": pa.array(headers, pa.string()), "payload": pa.array(payloads, pa.binary()),
            "bytes_left": pa.array(left, pa.int64())})

    for row in _frames(blob):
        rows.append(row)
        held += len(row[0] or "") + len(row[1] or b"")
        if held >= BATCH_BYTES:
            yield batch()
            first, held, rows = first + len(rows), 0, []
    if rows:
        yield batch()


def parse_header(frames: DataFrame, hmac_name: str = "hmac", header: str = "header") -> DataFrame:
    """Add the validation error of a JSON header and its fields as columns."""
    names = [*HEADER_FIELDS, *SIGNATURE_FIELDS]
    rows = validate_header(frames, header).withColumn("_parsed", F.from_json(header, FRAME_HEADER))
    parsed = F.col("_parsed")
    signature = F.try_element_at(F.from_json(header, "map<string,string>"), F.lit(hmac_name))
    field = lambda n: signature if n == "hmac" and hmac_name != "hmac" else parsed[n]
    return rows.withColumns({n: field(n) for n in names}).drop("_parsed")


def read_frame_table(spark: SparkSession, path: str, hmac_name: str = "hmac") -> DataFrame:
    """Frames from a Parquet table with a binary column ``frame``, as ``encode_frames`` makes it, one frame per row.

    Parquet splits and parallelizes where a wire file cannot, and the header is parsed without leaving Spark.
    """
    frame = F.col("frame")
    size = F.conv(F.hex(F.substring(frame, F.lit(1), F.lit(4))), 16, 10).cast("int")
    rows = spark.read.parquet(path).withColumn("header", F.substring(frame, F.lit(5), size).cast("string"))
    rows = rows.withColumn("payload", F.substring(frame, size + 5, F.octet_length(frame)))
    return parse_header(rows.select("header", "payload"), hmac_name)
