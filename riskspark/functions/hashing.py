"""Repeatable pseudo-random numbers from md5, the same for any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def digest(*parts) -> Column:
    """md5 hex of the parts joined by ``|``."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def hex_number(hex_text: Column, start: int = 1, digits: int = 8) -> Column:
    """``digits`` hex characters of ``hex_text`` as a non-negative bigint."""
    return F.conv(F.substring(hex_text, start, digits), 16, 10).cast("bigint")


def uniform(hex_text: Column) -> Column:
    """A double in (0, 1) from the first 13 hex digits (52 bits) of a digest."""
    return (hex_number(hex_text, 1, 13).cast("double") + F.lit(0.5)) / F.lit(float(2**52))
