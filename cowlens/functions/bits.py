"""Bit expressions of the image format. Words of 64 bits are two halves of 32, since Spark has no unsigned type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW32 = 0xFFFFFFFF


def big_endian(data: Column, at: Column | int, width: int) -> Column:
    """Unsigned big-endian integer of up to 7 bytes of a binary column, from a 0-based offset."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.hex(F.substring(data, (at + 1).cast("int"), F.lit(width))), 16, 10).cast("long")


def little_endian32(data: Column, at: Column | int) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    byte = lambda k: big_endian(data, at + k, 1)
    return byte(0) + byte(1) * 256 + byte(2) * 65_536 + byte(3) * 16_777_216


def halves(data: Column, at: Column | int) -> tuple[Column, Column]:
    """High and low half of a 64-bit word."""
    at = F.lit(at) if isinstance(at, int) else at
    return big_endian(data, at, 4), big_endian(data, at + 4, 4)


def masked(hi: Column, lo: Column, low_bit: int, high_bit: int) -> Column:
    """Bits low_bit..high_bit (below 63) of the word, in place."""
    mask = ((1 << (high_bit + 1)) - 1) & ~((1 << low_bit) - 1)
    return F.shiftleft(hi.bitwiseAND(mask >> 32), 32).bitwiseOR(lo.bitwiseAND(mask & LOW32))


def bit(hi: Column, lo: Column, n: int) -> Column:
    """Whether bit n (0..63) is set."""
    half, k = (hi, n - 32) if n >= 32 else (lo, n)
    return half.bitwiseAND(1 << k) != 0


def unsigned(hi: Column, lo: Column) -> Column:
    """The whole word as decimal(20,0)."""
    return (hi.cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(11,0)") + lo.cast("decimal(20,0)")).cast("decimal(20,0)")


def ceil_div(a: Column, b: int) -> Column:
    return F.floor((a + (b - 1)) / b).cast("long")


def align_up(a: Column, b: int) -> Column:
    return a + F.pmod(-a, F.lit(b))


def compressed_descriptor(word: Column, cluster_bits: int) -> tuple[Column, Column]:
    """(host offset, bytes) of a descriptor's 62 bits: sectors of 512 bytes, less the offset's place in the first."""
    x = 62 - (cluster_bits - 8)
    offset = word.bitwiseAND((1 << x) - 1)
    sectors = F.shiftrightunsigned(word, x).bitwiseAND((1 << (62 - x)) - 1)
    return offset, (sectors + 1) * 512 - offset.bitwiseAND(511)


def refcount_in_word(word32: Column, order: int, index: int) -> Column:
    """Count at `index` of a 32-bit big-endian word, for widths of 1 to 32 bits, most significant first."""
    width = 1 << order
    return F.shiftrightunsigned(word32, 32 - width * (index + 1)).bitwiseAND((1 << width) - 1)


def subcluster_state(alloc: Column, zero: Column, index: Column) -> Column:
    """A allocated, Z zero, U unallocated, ! invalid (both bits)."""
    a, z = F.getbit(alloc, index) == 1, F.getbit(zero, index) == 1
    return F.when(a & z, "!").when(a, "A").when(z, "Z").otherwise("U")


def state_map(alloc: Column, zero: Column) -> Column:
    """The 32 subclusters' states as text, lowest bit first."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: subcluster_state(alloc, zero, i)), "")


def subcluster_range(alloc: Column, zero: Column, first: Column, count: Column, state: str) -> tuple[Column, Column]:
    """(alloc, zero) after `count` subclusters from `first` on are set to a state: A, Z or U."""
    one = F.lit(1).cast("long")
    mask = F.call_function("shiftleft", F.call_function("shiftleft", one, count.cast("int")) - 1, first.cast("int"))
    on = lambda x: x.bitwiseOR(mask)
    off = lambda x: x.bitwiseAND(F.bitwise_not(mask))
    return on(alloc) if state == "A" else off(alloc), on(zero) if state == "Z" else off(zero)


def subclusters_valid(alloc: Column, zero: Column) -> Column:
    """No subcluster has both bits."""
    return alloc.bitwiseAND(zero) == 0
