"""Hashes, masks, packed fields and partition keys as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: FNV-1a, 64 bits.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def multiply64(a: Column, b: int) -> Column:
    """Product of longs modulo 2**64, by halves so that nothing overflows under ANSI rules."""
    lo = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))
    hi = lambda x: F.shiftrightunsigned(x, 32)
    b_lo, b_hi = F.lit(b & 0xFFFFFFFF), F.lit(b >> 32 & 0xFFFFFFFF)
    a_lo, a_hi = lo(a), hi(a)
    # each partial product is taken by 16-bit parts of b, which keeps it within 48 bits
    part = lambda x, y: (lo(x * y.bitwiseAND(F.lit(0xFFFF))), lo(F.shiftleft(lo(x * F.shiftright(y, 16)).bitwiseAND(F.lit(0xFFFF)), 16)))
    cross = [p for x, y in ((a_lo, b_hi), (a_hi, b_lo)) for p in part(x, y)]
    high = lo(sum(cross[1:], cross[0]))
    p0, p1 = a_lo * b_lo.bitwiseAND(F.lit(0xFFFF)), a_lo * F.shiftright(b_lo, 16)
    low_sum = lo(p0) + F.shiftleft(p1.bitwiseAND(F.lit(0xFFFF)), 16)
    carry = F.shiftright(p0, 32) + F.shiftright(p1, 16) + F.shiftright(low_sum, 32)
    return F.shiftleft(lo(high + carry), 32).bitwiseOR(lo(low_sum))


def fnv1a(text: Column) -> Column:
    """FNV-1a of a text's UTF-8 bytes, as a signed long."""
    codes = F.hex(text.cast("binary"))
    bytes_ = F.when(F.octet_length(text) == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.octet_length(text) - 1), lambda k: F.conv(F.substring(codes, 2 * k + 1, F.lit(2)), 16, 10).cast("long"))
    )
    return F.aggregate(bytes_, F.lit(_signed(FNV_OFFSET)), lambda h, b: multiply64(h.bitwiseXOR(b), FNV_PRIME))


def revision(*columns: Column) -> Column:
    """SHA-256 of a canonical JSON of the columns: the id of a record's contents."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def stem_bucket(stem: Column) -> Column:
    """703 partitions by the first two letters: 0 for no stem, then the letter alone, then letter pairs."""
    a = lambda k: F.ascii(F.substring(stem, k, 1)) - 96
    return F.when(F.length(stem) == 0, 0).when(F.length(stem) == 1, a(1) * 27 - 26).otherwise(a(1) * 27 - 26 + a(2))


def mark_masks(letters: Column, marks: Column) -> Column:
    """(known, long) from letters and an array of marks of the same length: L long, S short, other none;
    only vowels count."""
    place = F.sequence(F.lit(0), F.size(marks) - 1)
    vowel = lambda k: F.substring(letters, k + 1, F.lit(1)).isin(*"aeiouy")
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)

    def total(wanted: list[str]) -> Column:
        bits = F.transform(place, lambda k: F.when(vowel(k) & F.get(marks, k).isin(wanted), bit(k)).otherwise(F.lit(0).cast("long")))
        return F.when(F.size(marks) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x)))

    return F.struct(total(["L", "S"]).alias("known"), total(["L"]).alias("long"))


def pack_fields(fields: list[tuple[Column, int]]) -> Column:
    """Fields of the given bit widths in one long, the first lowest; a value that does not fit fails."""
    out, at = F.lit(0).cast("long"), 0
    for value, width in fields:
        fits = F.when((value >= 0) & (value < (1 << width)), value.cast("long")).otherwise(F.raise_error(F.lit(f"does not fit {width} bits")).cast("long"))
        out, at = out.bitwiseOR(F.shiftleft(fits, at)), at + width
    return out


def unpack_fields(packed: Column, widths: list[int]) -> list[Column]:
    out, at = [], 0
    for width in widths:
        out.append(F.shiftright(packed, at).bitwiseAND(F.lit((1 << width) - 1)).cast("int"))
        at += width
    return out


def hash_bucket(value: Column, seed: str, buckets: int = 100) -> Column:
    """0 to buckets - 1 from the first 32 bits of the SHA-256 of `seed:value`."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), value.cast("string")), 256), 1, 8), 16, 10).cast("long") % buckets
