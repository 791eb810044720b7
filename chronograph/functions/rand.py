"""Uniform numbers from a hash of explicit keys: no random state, so results depend on neither partitioning nor retries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key(part: Column | str | int) -> Column:
    return (F.lit(str(part)) if isinstance(part, (int, str)) else part).cast("string")


def uniform32(*parts: Column | str | int) -> Column:
    """The first 32 bits of the MD5 of the parts joined by ``|``, as a long. Strings and ints are literals."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(key(p) for p in parts))), 1, 8), 16, 10).cast("long")


def uniform(*parts: Column | str | int) -> Column:
    """A double in [0, 1)."""
    return uniform32(*parts).cast("double") / F.lit(float(2**32))


def sql_uniform(*parts: str) -> str:
    """The same number in DuckDB; ``parts`` are SQL expressions."""
    joined = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST(CAST('0x' || substr(md5(concat_ws('|', {joined})), 1, 8) AS BIGINT) AS DOUBLE) / CAST(4294967296 AS DOUBLE))"
