"""Keyed pseudo-random draws.

Every draw is a pure function of a key, so a task retried after an executor
loss draws the same numbers, and results do not depend on partitioning or
thread timing. The key is ``seed|purpose|part|part...``; the purpose string
('keep', 'window', 'init', 'shard') keeps draws for different uses apart.
MD5 is used because DuckDB has the same function, so SQL oracles can
recompute every draw.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: uniforms live on the same grid as the original generator's
# randomOne(), 16 bits -> k / 65536.
UNIFORM_STEPS = 65536


def draw_key(seed: int, purpose: str, *parts) -> Column:
    cols = [F.lit(str(seed)), F.lit(purpose)]
    for p in parts:
        cols.append(p.cast("string") if isinstance(p, Column) else F.lit(str(p)))
    return F.concat_ws("|", *cols)


def uniform16(key: Column, slot: Column | int = 0) -> Column:
    """Uniform in [0, 1) in steps of 1/65536 from 4 hex digits of md5(key).

    ``slot`` (0..7) picks one of the eight 4-digit groups of the digest, so one
    hash serves up to eight draws.
    """
    start = (F.lit(slot) if isinstance(slot, int) else slot) * 4 + 1
    digits = F.substr(F.md5(key), start, F.lit(4))
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(UNIFORM_STEPS))


def uniform_int(key: Column, modulus: int) -> Column:
    """Integer in 0..modulus-1 from 8 hex digits (32 bits) of md5(key)."""
    digits = F.substr(F.md5(key), F.lit(1), F.lit(8))
    return (F.conv(digits, 16, 10).cast("long") % F.lit(modulus)).cast("int")


def uniform32(key: Column) -> Column:
    """Uniform in [0, 1) in steps of 2**-32 from 8 hex digits of md5(key)."""
    digits = F.substr(F.md5(key), F.lit(1), F.lit(8))
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 32))
