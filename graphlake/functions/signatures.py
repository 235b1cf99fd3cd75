"""Content ids and query signatures; SHA-256 stands for any hash with equal id for equal content."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_id(data: Column) -> Column:
    return F.sha2(data, 256)


def json_content_id(*columns: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def path_signature(path: Column) -> Column:
    """Of an array of segments: order matters, every segment ends with NUL."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s, F.lit("\0"))), ""), 256)


def class_signature(classes: Column) -> Column:
    """As path_signature of the sorted classes; duplicates count."""
    return path_signature(F.array_sort(classes))


def path_signature_of(path: list[str]) -> str:
    return hashlib.sha256("".join(s + "\0" for s in path).encode()).hexdigest()


def class_signature_of(classes: list[str]) -> str:
    return path_signature_of(sorted(classes))
