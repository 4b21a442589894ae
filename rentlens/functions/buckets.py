"""Shards of keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def polynomial(key: Column, base: int = 31, modulus: int = 256) -> Column:
    """Hash of the characters' codes, modulo ``modulus``."""
    return F.aggregate(F.split(key, ""), F.lit(0), lambda h, c: (h * base + F.when(c == "", F.lit(0)).otherwise(F.ascii(c))) % modulus)


def sha_prefix(key: Column, digits: int = 2) -> Column:
    return F.substring(F.sha2(key, 256), 1, digits)


def tail(key: Column, n: int = 2) -> Column:
    return F.right(key, F.lit(n))
