"""Expressions and helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of digits, ASCII letters and everything beyond ASCII, in text whose A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of a side that may be broadcast after they have been counted; the rest goes through a shuffled join.
BROADCAST_ROWS = 200_000


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; pure ASCII text takes the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_array(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, a hash of the text that tells rows of one doc_id apart, the text and the columns asked for; others are left out, so none can clash."""
    return docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("h"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def join_keyed(left: DataFrame, right: DataFrame, how: str = "inner", names: tuple[str, ...] = ("doc_id", "h")) -> DataFrame:
    """Join on key columns in which null equals null; the left side's keys stay."""
    right = right.withColumnsRenamed({n: f"__{n}" for n in names})
    cond = F.lit(True)
    for n in names:
        cond = cond & left[n].eqNullSafe(right[f"__{n}"])
    return left.join(right, cond, how).drop(*[f"__{n}" for n in names])


def sized(df: DataFrame, rows: int) -> DataFrame:
    """Mark a counted side for broadcast if it is small enough; else leave the join to shuffling."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
