"""Stable hashes as columns: splits, fractions, signed feature buckets, content ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds of a stable split in percent: (upper bound, split).
SPLIT_80_10_10 = ((80, "train"), (90, "validation"), (100, "test"))


def be64(hex_digest: Column, start: int = 1) -> Column:
    """The unsigned number of 16 hex digits, as decimal(20, 0)."""
    return F.conv(F.substring(hex_digest, start, 16), 16, 10).cast("decimal(20,0)")


def percent64(text: Column) -> Column:
    """First 64 bits of the SHA-256, modulo 100."""
    return (be64(F.sha2(text, 256)) % 100).cast("long")


def percent256(text: Column) -> Column:
    """The whole SHA-256 as one number, modulo 100."""
    digits = F.transform(F.split(F.sha2(text, 256), ""), lambda d: F.conv(d, 16, 10).cast("long"))
    return F.aggregate(F.filter(digits, lambda d: d.isNotNull()), F.lit(0).cast("long"), lambda a, d: (a * 16 + d) % 100)


def stable_split(percent: Column, bounds: Sequence[tuple[int, str]] = SPLIT_80_10_10) -> Column:
    out = F.lit(bounds[-1][1])
    for upper, name in reversed(bounds[:-1]):
        out = F.when(percent < upper, name).otherwise(out)
    return out


def stable_fraction(text: Column) -> Column:
    """A number in [0, 1] from the first 64 bits of the SHA-256."""
    return be64(F.sha2(text, 256)).cast("double") / F.lit(18446744073709551615.0)


def signed_bucket(feature: Column, dim: int) -> tuple[Column, Column]:
    """Bucket (first 64 bits modulo ``dim``) and sign (by the ninth byte) of a feature."""
    digest = F.sha2(feature, 256)
    sign = F.when(F.conv(F.substring(digest, 17, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    return (be64(digest) % dim).cast("int"), sign


def short_id(*columns: Column) -> Column:
    """16 hex digits of the SHA-256 of the values; null and empty differ."""
    parts = [F.coalesce(F.concat(F.lit("s"), c.cast("string")), F.lit("n")) for c in columns]
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 16)
