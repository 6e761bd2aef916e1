"""Shared plumbing of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histomill.storage import stored as materialise  # noqa: F401 - the operators' name for it

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def small_side(df: DataFrame, max_rows: int = 200_000, max_bytes: int = 64 << 20) -> DataFrame:
    """Broadcast ``df`` only if it is proven to have at most ``max_rows`` rows, and these at most
    ``max_bytes`` bytes as text; otherwise leave the join to a shuffle."""
    size = F.sum(F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
    rows, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), size).first()
    return F.broadcast(df) if rows <= max_rows and (size or 0) <= max_bytes else df


def join_hot(big: DataFrame, unique: DataFrame, key: str, rows: str) -> DataFrame:
    """Inner join of ``big`` with a stored table that has each key once and the number of its
    rows in ``big``. Keys with over 1/200 of all rows, of which there are fewer than 200, are
    looked up by broadcast, so none of them meets in one task; the others shuffle."""
    total = unique.agg(F.sum(rows)).first()[0] or 0
    hot = [r[0] for r in unique.where(F.col(rows) > max(1000, total // 200)).select(key).collect()]
    if not hot:
        return big.join(unique, key)
    is_hot = F.col(key).isin(hot)
    rest = big.where(~is_hot).join(unique.where(~is_hot), key)
    return big.where(is_hot).join(F.broadcast(unique.where(is_hot)), key).unionByName(rest)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. ``lower`` is used where it gives the same result,
    that is where the text has no cased character outside ASCII."""
    other = r"[\x{80}-\x{10FFFF}&&[\p{Lu}\p{Lt}\p{Nl}\p{So}]]"
    return F.when(text.rlike(other), F.translate(text, ASCII_UPPER, ASCII_LOWER)).otherwise(F.lower(text))


def clashless(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, by exact position, so that other columns cannot clash."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
