"""Hash identities as column expressions: every random choice is a SHA-256 of named parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def stable_sha256(*parts: Column) -> Column:
    """SHA-256 of parts, each after its length in eight big-endian bytes; null if a part is null."""
    framed = []
    for part in parts:
        data = part.cast("string").cast("binary")
        framed += [F.unhex(F.lpad(F.hex(F.octet_length(data)), 16, "0")), data]
    return F.sha2(F.concat(*framed), 256)


def token_sha256(ids: Column) -> Column:
    """SHA-256 of token ids, four big-endian bytes each."""
    return F.sha2(F.unhex(F.array_join(F.transform(ids, lambda x: F.lpad(F.hex(x), 8, "0")), "")), 256)


def chunk_digest(ids: Column, bos: int, eos: int) -> Column:
    """SHA-256 of begin, ids and end as little-endian 32-bit numbers."""

    def little(x: Column) -> Column:
        h = F.lpad(F.hex(x), 8, "0")
        return F.concat(*[F.substring(h, at, 2) for at in (7, 5, 3, 1)])

    framed = F.concat(F.array(F.lit(bos)), ids, F.array(F.lit(eos)))
    return F.sha2(F.unhex(F.array_join(F.transform(framed, little), "")), 256)


def head_number(digest: Column, digits: int = 8) -> Column:
    """The first hexadecimal digits as a number: a long up to 15 digits, else a decimal."""
    number = F.conv(F.substring(digest, 1, digits), 16, 10)
    return number.cast("long" if digits < 16 else "decimal(20,0)")


def bucket(digest: Column, modulus: int) -> Column:
    return head_number(digest) % modulus


def full_mod5(digest: Column) -> Column:
    """A whole hexadecimal digest modulo 5: as 16 leaves 1, the sum of its digits does it."""
    digits = F.transform(F.split(digest, ""), lambda c: F.when(c == "", F.lit(0)).otherwise(F.conv(c, 16, 10).cast("int")))
    return F.aggregate(digits, F.lit(0), lambda a, x: a + x) % 5


def unit_less_than(digest: Column, rate: Column | float) -> Column:
    """Whether the first 64 bits, as a fraction of 2**64, lie below rate."""
    rate = F.lit(rate) if isinstance(rate, int | float) else rate
    return head_number(digest, 16).cast("double") / F.lit(18446744073709551616.0) < rate


def prompt_split(digest: Column) -> Column:
    """validation below 200 of 10,000, test below 400, else train."""
    at = bucket(digest, 10000)
    return F.when(at < 200, "validation").when(at < 400, "test").otherwise("train")


def percent_split(digest: Column) -> Column:
    """96 / 2 / 2 by the first eight digits modulo 100."""
    at = bucket(digest, 100)
    return F.when(at < 96, "train").when(at < 98, "validation").otherwise("test")
