"""Compression with per-topic dictionaries. The codecs run in Arrow batches; everything around them is Spark SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.auth import verify_frames
from ..functions.checks import MAX_BATCH_BYTES
from ..session import broadcast_if_small
from .registry import attach_active_dict, attach_dict_by_id, sample_window

# Defaults of the frame format.
LEVEL = 7
DICT_SIZE = 8192
CODECS = ("zstd", "zlib", "none")

#: Bytes of text after which the decoder hands a batch over.
DECODED_BYTES = 32 * 1024 * 1024
#: Bytes of a zstd payload decoded at a time; each can come to 128 KiB of text per 4 bytes before its length is judged.
ZSTD_STEP = 512


def _encoder(codec: str, level: int, dictionary: bytes | None) -> Callable[[bytes], bytes]:
    if codec == "zstd":
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        return zstandard.ZstdCompressor(level=level, dict_data=data).compress
    if codec == "zlib":
        extra = {"zdict": dictionary} if dictionary else {}

        def encode(payload: bytes) -> bytes:
            stream = zlib.compressobj(level=min(level, 9), **extra)
            return stream.compress(payload) + stream.flush()

        return encode
    return bytes


def _decoder(codec: str, dictionary: bytes | None) -> Callable[[bytes, int], bytes]:
    """A function of payload and the largest text it may give; a longer or incomplete text raises."""
    if codec == "zstd":
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        context = zstandard.ZstdDecompressor(dict_data=data)

        def decode_zstd(payload: bytes, most: int) -> bytes:
            stream, parts, size = context.decompressobj(), [], 0
            for start in range(0, len(payload), ZSTD_STEP):
                parts.append(stream.decompress(payload[start:start + ZSTD_STEP]))
                size += len(parts[-1])
                if stream.eof or size > most:
                    break
            if size > most or not stream.eof:
                raise zstandard.ZstdError("incomplete stream, or longer than announced")
            return b"".join(parts)

        return decode_zstd
    extra = {"zdict": dictionary} if dictionary else {}

    def decode_zlib(payload: bytes, most: int) -> bytes:
        stream = zlib.decompressobj(**extra)
        text = stream.decompress(payload, most + 1)
        if len(text) > most or not stream.eof:
            raise zlib.error("incomplete stream, or longer than announced")
        return text

    return decode_zlib


class _Cache(dict):
    """Codec objects of one task, the most recent ones only; a task sees few dictionaries at a time."""

    def get_or(self, key, make):
        if key not in self:
            if len(self) >= 256:
                self.clear()
            self[key] = make()
        return self[key]


def _check_codec(codec: str) -> None:
    if codec not in CODECS:
        raise ValueError(f"unknown codec {codec!r}, use one of {CODECS}")


def compress_batches(
    batches: DataFrame, registry: DataFrame, codec: str = "zstd", level: int = LEVEL, payload: str = "payload"
) -> DataFrame:
    """Compress each payload with the active dictionary of its topic.

    Without a dictionary, or if the codec fails, the payload stays raw: dict_id is empty and codec ``none``.
    Adds v, codec, level, dict_id and comp_len.
    """
    _check_codec(codec)
    if not 1 <= level <= 22:
        raise ValueError("level must be between 1 and 22")
    rows = attach_active_dict(batches, registry)
    fields = [f for f in rows.schema.fields if f.name != "dict_bytes"]
    out = T.StructType([*fields, T.StructField("codec", T.StringType()), T.StructField("comp_len", T.LongType())])

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Cache()
        for table in tables:
            ids, codecs, payloads = [], [], []
            dictionaries = table.column("dict_bytes")
            for i, (data, name) in enumerate(zip(table.column(payload), table.column("dict_id").to_pylist())):
                data, used = data.as_py() or b"", codec
                if not name or codec == "none":
                    name, used = "", "none"
                else:
                    try:
                        encode = cache.get_or(name, lambda: _encoder(codec, level, dictionaries[i].as_py()))
                        data = encode(data)
                    except (zstandard.ZstdError, zlib.error, ValueError):
                        name, used = "", "none"
                ids.append(name)
                codecs.append(used)
                payloads.append(data)
            columns = {name: table.column(name) for name in table.schema.names if name != "dict_bytes"}
            columns[payload] = pa.array(payloads, pa.binary())
            columns["dict_id"] = pa.array(ids, pa.string())
            columns["codec"] = pa.array(codecs, pa.string())
            columns["comp_len"] = pa.array([len(p) for p in payloads], pa.int64())
            yield pa.RecordBatch.from_pydict({f.name: columns[f.name] for f in out.fields})

    return rows.mapInArrow(run, out).withColumn("v", F.lit(1)).withColumn("level", F.lit(level))


class Decoded(NamedTuple):
    """frames: decoded frames with their text in ``raw``; lines: one row per message; rejected: frames with an error."""

    frames: DataFrame
    lines: DataFrame
    rejected: DataFrame


def decode_frames(
    frames: DataFrame, registry: DataFrame, key: str | None = None, algo: str = "sha256", payload: str = "payload",
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> Decoded:
    """Check the signature if *key* is given, look the dictionary up, then decompress; nothing unverified is decoded.

    Lines have the columns of the frame except the payload, plus pos and msg. Errors: signature, unknown_dict, corrupt.
    A frame is corrupt as well if its text has another length than its header says, or more than MAX_BATCH_BYTES; no more
    than that is ever decompressed. Texts are handed over every DECODED_BYTES, however small their frames were.
    *keep* is applied to the decompressed frames, for callers that use more than one of the results.
    """
    if key is not None:
        frames = verify_frames(frames, key, algo, payload)
        error = F.when(~F.col("verified"), "signature")
        frames = frames.withColumn("error", error).drop("verified")
    else:
        frames = frames.withColumn("error", F.lit(None).cast("string"))
    known = attach_dict_by_id(frames, registry)
    checked = known.withColumn("error", F.coalesce("error", F.when(~F.col("dict_known"), "unknown_dict"))).drop("dict_known")
    refused = checked.filter(F.col("error").isNotNull()).drop("dict_bytes")

    passed = checked.filter(F.col("error").isNull()).drop("error")
    fields = [f for f in passed.schema.fields if f.name not in ("dict_bytes", payload)]
    sized = "raw_len" in passed.columns
    out = T.StructType([
        *fields, T.StructField(payload, T.BinaryType()), T.StructField("raw", T.BinaryType()),
        T.StructField("error", T.StringType())])

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Cache()
        for table in tables:
            first, held, texts, errors = 0, 0, [], []
            dictionaries = table.column("dict_bytes")
            sizes = table.column("raw_len").to_pylist() if sized else [None] * table.num_rows
            rows = zip(table.column(payload), table.column("dict_id").to_pylist(), table.column("codec").to_pylist(), sizes)
            for i, (data, name, codec, size) in enumerate(rows):
                data, error = data.as_py(), None
                most = MAX_BATCH_BYTES if size is None else min(size, MAX_BATCH_BYTES)
                if name:
                    try:
                        decode = cache.get_or((name, codec), lambda: _decoder(codec, dictionaries[i].as_py()))
                        data = decode(data, most)
                    except (zstandard.ZstdError, zlib.error):
                        data, error = None, "corrupt"
                if data is not None and (len(data) > most or size is not None and len(data) != size):
                    data, error = None, "corrupt"
                texts.append(data)
                errors.append(error)
                held += len(data or b"")
                if held >= DECODED_BYTES or i == table.num_rows - 1:
                    part = table.slice(first, len(texts))
                    columns = {f.name: part.column(f.name) for f in fields}
                    columns[payload] = part.column(payload)
                    columns["raw"] = pa.array(texts, pa.binary())
                    columns["error"] = pa.array(errors, pa.string())
                    yield pa.RecordBatch.from_pydict(columns)
                    first, held, texts, errors = i + 1, 0, [], []

    decoded = passed.mapInArrow(run, out)
    if keep is not None:
        decoded = keep(decoded)
    good = decoded.filter(F.col("error").isNull()).drop("error")
    corrupt = decoded.filter(F.col("error").isNotNull()).drop("raw")
    return Decoded(good.drop(payload), frame_lines(good.drop(payload)), refused.unionByName(corrupt))


def frame_lines(decoded: DataFrame, raw: str = "raw") -> DataFrame:
    """One row per message of a decoded frame, with its position."""
    text = F.col(raw).cast("string")
    body = F.when(text.endswith("\n"), F.substring(text, F.lit(1), F.char_length(text) - 1)).otherwise(text)
    keep = [c for c in decoded.columns if c != raw]
    return decoded.select(*keep, F.posexplode(F.split(body, "\n")).alias("pos", "msg"))


def reconcile(frames: DataFrame, lines: DataFrame, on: list[str], msg: str = "msg") -> DataFrame:
    """Compare what each header announces with what was decoded; frames or lines without a partner disagree."""
    header = frames.select(*on, F.col("count").alias("header_count"), F.col("raw_len").alias("header_bytes"))
    seen = lines.groupBy(*on).agg(
        F.count(F.lit(1)).alias("decoded_count"), F.sum(F.octet_length(msg).cast("long") + 1).alias("decoded_bytes"))
    both = header.join(seen, on, "full_outer").fillna(0, ["header_count", "header_bytes", "decoded_count", "decoded_bytes"])
    agrees = (F.col("header_count") == F.col("decoded_count")) & (F.col("header_bytes") == F.col("decoded_bytes"))
    return both.withColumn("agrees", agrees)


# Training


def _train(method: str, samples: list[bytes], size: int) -> bytes:
    if method == "zstd":
        return zstandard.train_dictionary(size, samples).as_bytes()
    return (b"\n".join(samples) + b"\n")[:size]


def train_dicts(
    samples: DataFrame, size: int = DICT_SIZE, method: str = "zstd", min_samples: int = 1, *, topic: str = "topic",
    order: tuple[str, ...] = ("ts", "seq"), msg: str = "msg",
) -> DataFrame:
    """One dictionary per topic: (topic, dict_bytes, sample_count, sample_bytes, error).

    *samples* must be bounded per topic, as ``sample_window`` or ``budget_prefix`` leave them. Method ``zstd`` trains;
    ``prefix`` takes the first *size* bytes of the samples. A topic that cannot be trained has an error and no bytes.
    """
    if method not in ("zstd", "prefix"):
        raise ValueError(f"unknown method {method!r}")
    topic_type = samples.schema[topic].dataType
    out = T.StructType([
        T.StructField(topic, topic_type), T.StructField("dict_bytes", T.BinaryType()),
        T.StructField("sample_count", T.LongType()), T.StructField("sample_bytes", T.LongType()),
        T.StructField("error", T.StringType())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order])
        texts = [t.encode() for t in table.column(msg).to_pylist()]
        trained, error = None, None
        if len(texts) < min_samples:
            error = "too_few_samples"
        else:
            try:
                trained = _train(method, texts, size)
            except zstandard.ZstdError as problem:
                error = f"training_failed: {problem}"
        return pa.Table.from_pydict({
            topic: table.column(topic).slice(0, 1),
            "dict_bytes": pa.array([trained], pa.binary()),
            "sample_count": pa.array([len(texts)], pa.int64()),
            "sample_bytes": pa.array([sum(map(len, texts))], pa.int64()),
            "error": pa.array([error], pa.string()),
        })

    return samples.select(topic, *order, msg).filter(F.col(msg).isNotNull()).groupBy(topic).applyInArrow(run, out)


def train_global_dict(
    messages: DataFrame, size: int = DICT_SIZE, method: str = "zstd", max_samples: int = 10_000,
    max_bytes: int = 2 * 1024 * 1024, *, order: tuple[str, ...] = ("ts", "seq"), msg: str = "msg",
) -> DataFrame:
    """One dictionary for all topics together, under the topic ``*``, from the newest messages within both caps."""
    together = messages.select(F.lit("*").alias("topic"), *order, msg)
    return train_dicts(sample_window(together, max_samples, max_bytes, order=order, msg=msg), size, method,
                       order=order, msg=msg)


# Report


def compression_report(
    batches: DataFrame, trained: DataFrame, global_dict: DataFrame, codec: str = "zstd", level: int = LEVEL,
    payload: str = "payload",
) -> DataFrame:
    """Sizes per topic and method: raw, no_dict, global_dict, topic_dict; the topic ``*`` has the totals.

    *trained* and *global_dict* come from ``train_dicts`` and ``train_global_dict``. Every batch is compressed on its own.
    """
    _check_codec(codec)
    dictionaries = trained.select("topic", F.col("dict_bytes").alias("_topic_dict"))
    shared = global_dict.agg(F.first("dict_bytes", ignorenulls=True).alias("d")).scalar()
    rows = batches.select("topic", "count", "raw_len", payload).join(
        broadcast_if_small(dictionaries, "_topic_dict"), "topic", "left").withColumn("_global_dict", shared)
    methods = ["no_dict", "global_dict", "topic_dict"]
    out = T.StructType.fromDDL("topic string, count bigint, raw_len bigint, " + ", ".join(f"{m} bigint" for m in methods))

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Cache()
        for table in tables:
            sizes: dict[str, list] = {m: [] for m in methods}
            topics = table.column("topic").to_pylist()
            for i, data in enumerate(table.column(payload)):
                data = data.as_py()
                for method in methods:
                    dictionary = None if method == "no_dict" else table.column("_" + method)[i]
                    if dictionary is not None and not dictionary.is_valid:
                        sizes[method].append(None)
                        continue
                    key = (method, topics[i] if method == "topic_dict" else None)
                    encode = cache.get_or(key, lambda: _encoder(
                        codec, level, None if dictionary is None else dictionary.as_py()))
                    sizes[method].append(len(encode(data)))
            yield pa.RecordBatch.from_pydict({
                "topic": table.column("topic"), "count": table.column("count"), "raw_len": table.column("raw_len"),
                **{m: pa.array(sizes[m], pa.int64()) for m in methods}})

    sized = rows.mapInArrow(run, out)
    totals = sized.rollup("topic").agg(
        F.grouping("topic").alias("_all"), F.sum("count").alias("messages"), F.sum("raw_len").alias("raw_total"),
        *[F.sum(m).alias(m) for m in methods])
    long = totals.withColumn("raw", F.col("raw_total")).unpivot(
        ["topic", "_all", "messages", "raw_total"], ["raw", *methods], "method", "comp_total")
    ratio = F.col("comp_total") / F.greatest("raw_total", F.lit(1))
    return long.filter(F.col("comp_total").isNotNull()).select(
        F.when(F.col("_all") == 1, "*").otherwise(F.col("topic")).alias("topic"), "method", "messages", "raw_total",
        (F.col("raw_total") / F.col("messages")).alias("raw_avg"), "comp_total",
        (F.col("comp_total") / F.col("messages")).alias("comp_avg"), ratio.alias("ratio"),
        F.round((1 - ratio) * 100, 1).alias("savings_pct"))


def compression_report_wide(report: DataFrame) -> DataFrame:
    """One row per topic with total, average and ratio of each method."""
    return report.groupBy("topic", "messages", "raw_total").pivot("method", ["no_dict", "global_dict", "topic_dict"]).agg(
        F.first("comp_total").alias("total"), F.first("comp_avg").alias("avg"), F.first("ratio").alias("ratio"))
