"""Declared schemas of messages, frames and logs."""

from __future__ import annotations

#: Message shapes of the sample feeds; any other schema works the same way.
FILE_METADATA = "file_type STRING, path STRING, size BIGINT, checksum STRING, timestamp BIGINT"
SENSOR = "sensor_id STRING, type STRING, value DOUBLE, unit STRING, timestamp BIGINT, location STRING"
CAMERA = (
    "camera STRING, frame BIGINT, "
    "objects ARRAY<STRUCT<type: STRING, bbox: ARRAY<INT>, confidence: DOUBLE>>, timestamp BIGINT"
)
VEHICLE = (
    "topic STRING, device_id STRING, status STRING, "
    "data STRUCT<velocity: DOUBLE, location: STRUCT<lat: DOUBLE, lng: DOUBLE>, engine_temp: DOUBLE>, "
    "headers MAP<STRING, STRING>"
)

FRAME_HEADER = (
    "v INT, topic STRING, codec STRING, level INT, dict_id STRING, schema_id STRING, count BIGINT, "
    "raw_len BIGINT, comp_len BIGINT, t0 DOUBLE, t1 DOUBLE, hmac STRING, hmac_algo STRING"
)
FRAME_METRICS = (
    "timestamp DOUBLE, topic STRING, count BIGINT, raw_bytes BIGINT, compressed_bytes BIGINT, ratio DOUBLE, "
    "dict_id STRING"
)
DICT_INDEX_ENTRY = "dict_id STRING, path STRING, size BIGINT, version INT, created_at DOUBLE"
REGISTRY = (
    "topic STRING, version INT, dict_id STRING, dict_bytes BINARY, created_at DOUBLE, retired_at DOUBLE"
)
PENDING = "id BIGINT, topic STRING, payload BINARY, timestamp DOUBLE"
TIMELINE = (
    "timestamp DOUBLE, step STRING, buffer_count BIGINT, breaker_state STRING, msgs_processed BIGINT, "
    "bytes_in BIGINT, bytes_out BIGINT, ratio DOUBLE"
)
