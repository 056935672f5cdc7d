"""Stable identifiers and hash shards."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _sha1(text: Column) -> Column:
    return F.sha1(text)


def file_slug(path: Column) -> Column:
    """File-system-safe name of a path: unsafe runs to '_', cut to 180, 8 hash digits appended."""
    safe = F.regexp_replace(path, "[^A-Za-z0-9._-]+", "_")
    return F.concat(F.substring(safe, 1, 180), F.lit("_"), F.substring(_sha1(path), 1, 8))


def chunk_id(path: Column, ordinal: Column) -> Column:
    return F.concat(file_slug(path), F.lit(":"), ordinal.cast("string"))


def figure_id(path: Column, page: Column) -> Column:
    key = F.concat(path, F.lit(":"), page.cast("string"))
    return F.concat(F.lit("fig:"), F.substring(_sha1(key), 1, 16))


def claim_id(doc: Column, ordinal: Column, claim: Column) -> Column:
    """Depends on the whole claim, so an edited claim gets a new id wherever the edit is."""
    key = F.concat(doc, F.lit(":"), ordinal.cast("string"), F.lit(":"), claim)
    return F.substring(_sha1(key), 1, 16)


def hash_shard(key: Column, shards: int) -> Column:
    """The 160-bit SHA-1 of ``key`` modulo ``shards``, folded digit by digit in 64-bit arithmetic."""
    digest = _sha1(key)
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(40)),
        F.lit(0).cast("bigint"),
        lambda acc, i: F.pmod(acc * 16 + F.conv(F.substring(digest, i, F.lit(1)), 16, 10).cast("bigint"), F.lit(shards)),
    ).cast("int")
