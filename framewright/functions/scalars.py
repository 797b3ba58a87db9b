"""Column expressions for ratios, queue pressure and dictionary identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def compression_ratio(raw: Column, comp: Column) -> Column:
    """Compressed over raw bytes, with raw counted as at least one byte."""
    return comp / F.greatest(raw, F.lit(1))


def savings_pct(raw: Column, comp: Column) -> Column:
    return F.round((1 - compression_ratio(raw, comp)) * 100, 1)


def ratio_cols(df: DataFrame, raw: str = "raw_len", comp: str = "comp_len", count: str = "count") -> DataFrame:
    """Add ratio, bytes_saved, savings_pct and bytes_per_msg."""
    r, c = F.col(raw), F.col(comp)
    return df.withColumns({
        "ratio": compression_ratio(r, c),
        "bytes_saved": r - c,
        "savings_pct": savings_pct(r, c),
        "bytes_per_msg": c / F.greatest(F.col(count), F.lit(1)),
    })


def pressure(queued: Column, soft: int, hard: int) -> Column:
    """0 up to the soft limit, then linear to 1 at the hard limit."""
    return F.when(queued <= soft, F.lit(0.0)).otherwise(F.least(F.lit(1.0), (queued - soft) / F.lit(float(hard - soft))))


def pressure_cols(
    df: DataFrame, soft: int = 1_000, hard: int = 5_000, max_delay: float = 100.0, queued: str = "queued"
) -> DataFrame:
    """Add pressure (4 digits), delay_ms and queue_pct (1 digit) of a queue length."""
    if soft < 0 or hard < 1 or soft >= hard:
        raise ValueError("limits must satisfy 0 <= soft < hard")
    q = F.col(queued)
    ramp = F.least(F.lit(float(max_delay)), F.lit(float(max_delay)) * (q - soft) / F.lit(float(hard - soft)))
    return df.withColumns({
        "pressure": F.round(pressure(q, soft, hard), 4),
        "delay_ms": F.when(q <= soft, F.lit(0.0)).otherwise(ramp),
        "queue_pct": F.round(q / hard * 100, 1),
    })


def dict_id(topic: Column, version: Column, dict_bytes: Column) -> Column:
    """``d:{topic}:v{version}:{first 12 hex digits of sha256}``, with dots and dashes of the topic as underscores."""
    safe = F.translate(topic, ".-", "__")
    return F.concat(F.lit("d:"), safe, F.lit(":v"), version.cast("string"), F.lit(":"),
                    F.substring(F.sha2(dict_bytes, 256), 1, 12))


def trained_dict_id(topic: Column, dict_bytes: Column) -> Column:
    """``d:{topic}:{first 16 hex digits of sha256}``, as the stand-alone trainer names its output."""
    return F.concat(F.lit("d:"), topic, F.lit(":"), F.substring(F.sha2(dict_bytes, 256), 1, 16))


def dict_file_name(topic: Column, version: Column) -> Column:
    """``{topic}.v{version}.dict``, with dots and slashes of the topic as underscores."""
    return F.concat(F.translate(topic, "./", "__"), F.lit(".v"), version.cast("string"), F.lit(".dict"))
