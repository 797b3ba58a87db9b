"""Keyed signatures (RFC 2104) from built-in hash expressions.

The padded keys become literals of the plan, so a plan or event log shows them: restrict those like the key itself.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

# Digest size in bits, block size in bytes.
ALGORITHMS = {"sha256": (256, 64), "sha384": (384, 128), "sha512": (512, 128)}


def hmac_hex(payload: Column, key: str, algo: str = "sha256") -> Column:
    """Hex HMAC of a binary column under a hex-encoded key."""
    if algo not in ALGORITHMS:
        raise ValueError(f"unsupported algorithm {algo!r}, use one of {sorted(ALGORITHMS)}")
    bits, block = ALGORITHMS[algo]
    secret = bytes.fromhex(key)
    if len(secret) > block:
        secret = hashlib.new(algo, secret).digest()
    secret = secret.ljust(block, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in secret)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, payload), bits))), bits)


def _signed(payload: str, header: str | None) -> Column:
    return F.concat(F.encode(header, "utf-8"), F.col(payload)) if header else F.col(payload)


def sign_frames(
    df: DataFrame, key: str, algo: str = "sha256", payload: str = "payload", header: str | None = None
) -> DataFrame:
    """Add hmac and hmac_algo; the signature covers the payload, preceded by the text column *header* if one is named."""
    return df.withColumns({"hmac": hmac_hex(_signed(payload, header), key, algo), "hmac_algo": F.lit(algo)})


def verify_frames(
    df: DataFrame, key: str, algo: str = "sha256", payload: str = "payload", signature: str = "hmac",
    algorithm: str = "hmac_algo", header: str | None = None,
) -> DataFrame:
    """Add verified; a missing signature or an unknown algorithm is invalid. *algo* applies where none is named."""
    named = F.coalesce(F.col(algorithm), F.lit(algo)) if algorithm in df.columns else F.lit(algo)
    valid = F.lit(False)
    for name in ALGORITHMS:
        valid = F.when(named == name, F.col(signature) == hmac_hex(_signed(payload, header), key, name)).otherwise(valid)
    return df.withColumn("verified", F.coalesce(valid, F.lit(False)))
