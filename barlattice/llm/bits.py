"""A bitmap of fixed size over 64-bit hashes, for pruning ahead of exact steps.

Its size is a parameter and does not grow with the data. Two hashes may share a
bit, so a set bit means "perhaps"; every use keeps what is perhaps needed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bitmap(hashes: DataFrame, column: str, power: int) -> np.ndarray:
    """2**power bits; those of the hashes in ``column`` are set.

    Bits are or-ed together in words of 64 on the executors; at most
    2**(power - 6) words come to the driver.
    """
    bit = F.shiftrightunsigned(F.col(column), 64 - power)
    words = (
        hashes.select(F.shiftrightunsigned(bit, 6).alias("word"), F.expr("1L").alias("one"), bit.alias("bit"))
        .select("word", F.expr("shiftleft(one, cast(bit & 63L as int))").alias("bits"))
        .groupBy("word")
        .agg(F.bit_or("bits").alias("bits"))
        .toArrow()
    )
    out = np.zeros(1 << (power - 6), dtype=np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def probe(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the uint64 ``hashes`` have their bit set."""
    power = len(bits).bit_length() - 1 + 6
    at = hashes >> np.uint64(64 - power)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0
