"""Identities of nodes and edges as column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\0"


def node_id(kind: Column, name: Column, qualified_name: Column, path: Column) -> Column:
    """sha1 of type, qualified name (or name) and path, separated by NUL. An empty path is a repository-wide identity."""
    own = F.coalesce(F.nullif(qualified_name, F.lit("")), name, F.lit(""))
    return F.sha1(F.concat_ws(NUL, kind, own, F.coalesce(path, F.lit(""))).cast("binary"))


def edge_id(kind: Column, source: Column, target: Column, path: Column, start_line: Column) -> Column:
    line = F.coalesce(start_line, F.lit(0)).cast("string")
    return F.sha1(F.concat_ws(NUL, kind, source, target, F.coalesce(path, F.lit("")), line).cast("binary"))


def identity(kind: Column, name: Column, qualified_name: Column, path: Column) -> Column:
    """A node's stable text: what node_id() is a hash of, to be read."""
    return F.concat(kind, F.lit(":"), F.coalesce(F.nullif(qualified_name, F.lit("")), name), F.lit("@"), F.coalesce(path, F.lit("")))


def node_fact(own: Column) -> Column:
    return F.concat(F.lit("node|"), own)


def edge_fact(kind: Column, source: Column, target: Column, path: Column) -> Column:
    return F.concat_ws("|", F.lit("edge"), kind, source, target, path)


def packed(key: Column) -> Column:
    """The 20 bytes of a hexadecimal sha1, half of what its digits take where keys are shuffled; other texts after 21 zeros, so that none is equal."""
    return F.when(key.rlike(r"\A[0-9a-f]{40}\z"), F.unhex(key)).otherwise(F.concat(F.lit(bytes(21)), key.cast("binary")))


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def node_key(kind: str, name: str, qualified_name: str = "", path: str = "") -> str:
    """node_id() of Python values, for parsers."""
    return hashlib.sha1(NUL.join((kind, qualified_name or name, path)).encode()).hexdigest()


def edge_key(kind: str, source: str, target: str, path: str = "", start_line: int | None = None) -> str:
    return hashlib.sha1(NUL.join((kind, source, target, path, str(start_line or 0))).encode()).hexdigest()
