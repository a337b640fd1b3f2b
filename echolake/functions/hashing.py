"""FNV-1a over UTF-8 bytes, in SQL expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Offset basis 0xcbf29ce484222325 in two halves; the prime is 2^40 + 0x1b3.
_HIGH, _LOW = 0xCBF29CE4, 0x84222325
_PRIME_LOW = 0x1B3
_MASK = 0xFFFFFFFF


def fnv1a_hex(text: Column) -> Column:
    """The 64-bit hash as 16 lower-case hex digits.

    State is kept in two 32-bit halves, since a 64-bit product overflows under ANSI rules: with h = a*2^32 + b, h*prime
    is b*0x1b3 + (a*0x1b3 + b*2^8)*2^32 modulo 2^64.
    """
    # the bytes are cut apart once, so the work is linear in the text
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), F.lit(0))
    start = F.struct(F.lit(_HIGH).cast("long").alias("a"), F.lit(_LOW).cast("long").alias("b"))

    def step(h: Column, pair: Column) -> Column:
        byte = F.conv(pair, 16, 10).cast("long")
        b = h["b"].bitwiseXOR(byte)
        low = b * _PRIME_LOW
        high = h["a"] * _PRIME_LOW + F.shiftleft(b, 8) + F.shiftright(low, 32)
        return F.struct(high.bitwiseAND(F.lit(_MASK)).alias("a"), low.bitwiseAND(F.lit(_MASK)).alias("b"))

    done = F.aggregate(pairs, start, step, lambda h: F.concat(F.lpad(F.hex(h["a"]), 8, "0"), F.lpad(F.hex(h["b"]), 8, "0")))
    return F.lower(done)


def digest(text: Column) -> Column:
    """``len=<bytes>,h=<hash>``: what is logged in place of a text."""
    t = F.coalesce(text, F.lit(""))
    return F.concat(F.lit("len="), F.octet_length(t).cast("string"), F.lit(",h="), fnv1a_hex(t))
