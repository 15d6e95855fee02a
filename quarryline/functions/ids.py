"""Deterministic ids as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The DNS namespace of UUIDs; a fixed value.
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = DNS_NAMESPACE) -> Column:
    """Version 5 UUID of a name."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def point_id(doc_id: Column, chunk_index: Column) -> Column:
    return uuid5(F.concat(doc_id.cast("string"), F.lit("_"), chunk_index.cast("string")))


def fingerprint(content: Column, read_bytes: int = 8192) -> Column:
    """24 hex digits of the size and the first bytes of a binary."""
    head = F.concat(F.encode(F.octet_length(content).cast("string"), "UTF-8"), F.substring(content, 1, read_bytes))
    return F.substring(F.sha2(head, 256), 1, 24)


def cache_key(path: Column, mtime: Column, parser: Column, method: Column) -> Column:
    """md5 of a JSON object of the four, keys sorted, a space after each comma and colon."""

    def quoted(value: Column) -> Column:
        # A struct's JSON is {"v":"..."}: what stands after the colon is the escaped string.
        return F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)

    text = F.concat(
        F.lit('{"file_path": '), quoted(path), F.lit(', "mtime": '), mtime.cast("string"), F.lit(', "parse_method": '), quoted(method), F.lit(', "parser": '), quoted(parser), F.lit("}"),
    )
    return F.md5(text)


def data_hash(value: Column) -> Column:
    """SHA-256 of a value's JSON; maps are written as entries in key order, so equal maps hash alike."""
    return F.sha2(F.to_json(F.struct(value.alias("v"))), 256)


def output_dir(path: Column) -> Column:
    """File stem and the first 8 hex digits of the path's md5."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")
    return F.concat(stem, F.lit("_"), F.substring(F.md5(path), 1, 8))
