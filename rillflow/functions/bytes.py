"""Reading bytes, and writing addresses, as column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from ipaddress import IPv6Address

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def part(frame: Column, offset: Column | int, n: int) -> Column:
    """n bytes at an offset from 0."""
    start = F.lit(offset + 1) if isinstance(offset, int) else offset + 1
    return F.substr(frame, start, F.lit(n))


def uint(frame: Column, offset: Column | int, n: int) -> Column:
    """A big-endian unsigned number of n bytes."""
    return F.conv(F.hex(part(frame, offset, n)), 16, 10).cast("bigint")


def mac_text(mac: Column) -> Column:
    return F.lower(F.regexp_replace(F.hex(mac), "(..)(?!$)", "$1:"))


@F.pandas_udf(T.StringType())
def _v6_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        told = {b: None if b is None else str(IPv6Address(bytes(b))) for b in s.unique()}
        yield s.map(told)


def v4_text(ip: Column) -> Column:
    return F.concat_ws(".", *[uint(ip, i, 1).cast("string") for i in range(12, 16)])


def ip_text(ip: Column, version: Column) -> Column:
    """Dotted quad of the last four bytes for version 4, the shortest hexadecimal form else."""
    return F.when(version == 4, v4_text(ip)).otherwise(_v6_text(F.when(version == 4, F.lit(None)).otherwise(ip)))


def byte_entropy(data: Column) -> Column:
    """Shannon entropy in bits of the bytes; 0 for none, or for zeros alone."""
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(data), F.lit(1))), lambda i: F.substr(data, i, F.lit(1)))
    n = F.length(data).cast("double")
    shares = F.transform(F.array_distinct(each), lambda b: F.size(F.filter(each, lambda x: x == b)) / n)
    return F.when(F.coalesce(F.length(data), F.lit(0)) == 0, F.lit(0.0)).otherwise(F.abs(F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p))))
