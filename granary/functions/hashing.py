"""Keyed numbers that do not depend on partitioning or row order."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_u01(*keys: Column, seed: int = 0, salt: int = 0) -> Column:
    """Uniform in [0, 1): 13 hex digits of the md5 of `seed|salt|key|...` over 2^52. A null key hashes as empty text."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(str(salt)), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def u01_sql(*keys: str, seed: int = 0, salt: int = 0) -> str:
    """The same number as SQL text."""
    parts = " || '|' || ".join([f"'{seed}|{salt}'", *[f"coalesce({k}::VARCHAR, '')" for k in keys]])
    return f"(('0x' || substr(md5({parts}), 1, 13))::BIGINT / 4503599627370496.0)"


def jitter_pct(*keys: Column) -> Column:
    """In [-0.02, 0.02] by steps of 0.0001: the low 64 bits of the md5 of `key|...`, modulo 401."""
    digest = F.md5(F.concat_ws("|", *[k.cast("string") for k in keys]).cast("binary"))
    low = F.conv(F.substring(digest, 17, 16), 16, 10).cast("decimal(20,0)")
    return ((low % F.lit(401).cast("decimal(20,0)")).cast("int") - 200) / F.lit(10_000.0)


def jitter_sql(*keys: str) -> str:
    text = " || '|' || ".join(f"{k}::VARCHAR" for k in keys)
    return f"(((('0x' || substr(md5({text}), 17, 16))::UBIGINT % 401)::INTEGER - 200) / 10000.0::DOUBLE)"
