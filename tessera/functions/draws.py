"""Repeatable draws that every engine can repeat: checksum texts of a seed and some columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hash_text(seed: int | Column, *cols: str) -> Column:
    first = seed if isinstance(seed, Column) else F.lit(seed)
    return F.md5(F.concat_ws("|", first.cast("string"), *[F.col(x).cast("string") for x in cols]))


def unit(seed: int | Column, *cols: str) -> Column:
    """A number between 0 and 1 from the first 28 bits."""
    return (F.conv(F.substring(hash_text(seed, *cols), 1, 7), 16, 10).cast("double") + 0.5) / (1 << 28)


def unit_sql(seed: str | int, *cols: str) -> str:
    text = " || '|' || ".join([f"cast({seed} as varchar)", *[f"cast({x} as varchar)" for x in cols]])
    return f"((cast('0x' || substr(md5({text}), 1, 7) as bigint) + 0.5) / {1 << 28})"


def hash_sql(seed: str | int, *cols: str) -> str:
    return "md5(" + " || '|' || ".join([f"cast({seed} as varchar)", *[f"cast({x} as varchar)" for x in cols]]) + ")"
