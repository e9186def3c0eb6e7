"""Randomness as a pure function of names: integers, uniforms, signs and Gaussians from md5 and sha256 digests.

Every draw is a Column, so it is the same on any partitioning and after any retry. ``sql_*`` give the DuckDB text of
the same values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def key(*parts) -> Column:
    """Parts joined by underscores, as text."""
    return F.concat_ws("_", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))


def hex32(digest: Column, chunk: int = 0) -> Column:
    """The chunk-th 32-bit integer of a hexadecimal digest."""
    return F.conv(F.substring(digest, 8 * chunk + 1, 8), 16, 10).cast("long")


def h32(name: Column, chunk: int = 0) -> Column:
    return hex32(F.md5(name), chunk)


def uniform(name: Column, chunk: int = 0) -> Column:
    """In the open unit interval."""
    return (h32(name, chunk) + 0.5) / 4294967296.0


def sign(name: Column) -> Column:
    """+1 or -1 by bit 8 of the first chunk."""
    return F.when(F.shiftright(h32(name), 8) % 2 == 0, F.lit(1)).otherwise(F.lit(-1))


def gaussian(name: Column) -> Column:
    """Standard normal by Box-Muller on two chunks of one digest."""
    return F.sqrt(-2.0 * F.ln(uniform(name, 0))) * F.cos(2.0 * math.pi * uniform(name, 1))


def md5_mod(name: Column, modulus: int | Column) -> Column:
    """The whole 128-bit digest modulo a number below 2**31, folded 32 bits at a time."""
    b = modulus if isinstance(modulus, Column) else F.lit(modulus)
    acc = F.lit(0).cast("long")
    for c in range(4):
        acc = (acc * F.lit(4294967296 % (1 << 62)) + h32(name, c)) % b
    return acc


def leading_zero_bits(hexed: Column) -> Column:
    """Leading zero bits of a hexadecimal string of 56 digits; 224 if all are zero."""
    rest = F.ltrim(hexed, F.lit("0"))
    first = F.substring(rest, 1, 1)
    nibble = F.when(first == "1", 3).when(first.isin("2", "3"), 2).when(first.isin("4", "5", "6", "7"), 1).otherwise(0)
    return ((56 - F.length(rest)) * 4 + nibble).cast("int")


def sql_h32(name: str, chunk: int = 0) -> str:
    return f"(('0x' || substr(md5({name}), {8 * chunk + 1}, 8))::BIGINT)"


def sql_uniform(name: str, chunk: int = 0) -> str:
    return f"(({sql_h32(name, chunk)} + 0.5) / 4294967296.0)"


def sql_sign(name: str) -> str:
    return f"(CASE WHEN ({sql_h32(name)} >> 8) % 2 = 0 THEN 1 ELSE -1 END)"


def sql_gaussian(name: str) -> str:
    return f"(sqrt(-2.0 * ln({sql_uniform(name, 0)})) * cos(2.0 * pi() * {sql_uniform(name, 1)}))"


def sql_md5_mod(name: str, modulus: int | str) -> str:
    acc = "0::BIGINT"
    for c in range(4):
        acc = f"((({acc}) * 4294967296 + {sql_h32(name, c)}) % {modulus})"
    return acc


def sql_leading_zero_bits(hexed: str) -> str:
    rest = f"ltrim({hexed}, '0')"
    return (
        f"((56 - length({rest})) * 4 + CASE WHEN substr({rest}, 1, 1) = '1' THEN 3 WHEN substr({rest}, 1, 1) IN ('2','3') THEN 2 "
        f"WHEN substr({rest}, 1, 1) IN ('4','5','6','7') THEN 1 ELSE 0 END)::INTEGER"
    )
