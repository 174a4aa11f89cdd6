"""Replay keys: short hashes over canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha16(col: Column) -> Column:
    """First 16 hex digits of SHA-256 over UTF-8 text."""
    return F.substring(F.sha2(col, 256), 1, 16)


def _escape_char(ch: Column) -> Column:
    units = F.lower(F.hex(F.encode(ch, "UTF-16BE")))
    return F.regexp_replace(units, "(....)", r"\\u$1")


def ascii_json(col: Column) -> Column:
    r"""JSON text with every non-ASCII character as ``\uXXXX`` (surrogate pairs too)."""
    chars = F.regexp_extract_all(col, F.lit("((?s).)"), F.lit(1))
    escaped = F.array_join(
        F.transform(chars, lambda c: F.when(F.rlike(c, F.lit("[^\\x00-\\x7F]")), _escape_char(c)).otherwise(c)), ""
    )
    return F.when(F.rlike(col, F.lit("[^\\x00-\\x7F]")), escaped).otherwise(col)


def input_sha(system_prompt_sha: Column, messages: Column, context_chunks: Column, tools: Column) -> Column:
    """Replay key of a request: member names in alphabetical order, tools sorted."""
    none = F.array().cast("array<string>")
    canonical = F.to_json(
        F.struct(
            F.coalesce(context_chunks, none).alias("context_chunks"),
            F.coalesce(messages, none).alias("messages"),
            system_prompt_sha.alias("system_prompt_sha"),
            F.array_sort(F.coalesce(tools, none)).alias("tools_offered"),
        )
    )
    return sha16(ascii_json(canonical))
