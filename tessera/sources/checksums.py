"""CRC-32 of files from the CRC-32s of their blocks, so that blocks are summed in parallel and combined in Spark."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
#: Files of up to 2**BITS bytes.
BITS = 44


def _times(matrix: tuple[int, ...], vector: int) -> int:
    out = 0
    for bit, column in enumerate(matrix):
        if vector >> bit & 1:
            out ^= column
    return out


@cache
def power(k: int) -> tuple[int, ...]:
    """What 2**k zero bytes do to a CRC-32: the 32 columns of a matrix over GF(2)."""
    if k:
        half = power(k - 1)
        return tuple(_times(half, c) for c in half)
    one_bit, out = (POLYNOMIAL, *(1 << i for i in range(31))), tuple(1 << i for i in range(32))
    for _ in range(8):
        out = tuple(_times(one_bit, c) for c in out)
    return out


def shifted(crc: Column, zeros: Column) -> Column:
    """A block's CRC-32 (long) as part of the CRC-32 of a file in which `zeros` bytes follow the block."""
    matrices = F.array(*(F.array(*(F.lit(c).cast("long") for c in power(k))) for k in range(BITS)))

    def bit(x: Column, i: Column) -> Column:
        return F.call_function("shiftright", x, i.cast("int")).bitwiseAND(F.lit(1).cast("long"))

    def times(k: Column, vector: Column) -> Column:
        parts = F.transform(F.element_at(matrices, (k + 1).cast("int")), lambda c, i: c * bit(vector, i))
        return F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))

    steps = F.sequence(F.lit(0), F.lit(BITS - 1))
    return F.aggregate(steps, crc.cast("long"), lambda c, k: F.when(bit(zeros, k) == 1, times(k, c)).otherwise(c))


def combined(blocks: DataFrame, by: list[str]) -> DataFrame:
    """by, crc32, size of files from blocks: by, offset, size, total (the file's size), crc32; blocks may come in any order, each once."""
    part = shifted(F.col("crc32"), F.col("total") - F.col("offset") - F.col("size"))
    return blocks.withColumn("part", part).groupBy(*by).agg(F.bit_xor("part").alias("crc32"), F.sum("size").alias("size"))
