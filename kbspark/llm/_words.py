"""Words of normalised text as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words: all of ASCII but digits and lower-case letters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LEAST = -(2**63)


def lower_ascii(text: str | Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: str | Column) -> Column:
    """The words of a text after lower-casing A-Z; a null text has none."""
    return F.array_remove(F.split(F.coalesce(lower_ascii(text), F.lit("")), GAP), "")


def doc_key() -> list[Column]:
    """``k1, k2``: a document is its id (null: the least) and its text; rows that repeat both are one."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("k1"), F.xxhash64("text").alias("k2")]


def own_names(df: DataFrame, *tags: str) -> list[str]:
    """A column name for each of ``tags`` that ``df`` does not have, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for tag in tags:
        while tag.lower() in taken:
            tag = f"_{tag}"
        taken.add(tag.lower())
        out.append(tag)
    return out
