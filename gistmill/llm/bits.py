"""Bit filters of bounded size over 64-bit keys: a lossless pre-filter before a shuffle (no key is ever missed).

A filter only saves shuffled rows; whoever uses one joins the keys exactly afterwards. It has 16 bits a key up to
``MOST_BYTES`` and then fewer, down to ``LEAST_BITS`` a key. For more keys than that there is none: rows then all go to the
exact join, whose shuffle is in proportion to the input.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of one filter at most: what is broadcast, and about a third of what the driver holds while it is built.
MOST_BYTES = 32 << 20
LEAST_BITS = 4
PROBES = 2


def build(keys: DataFrame, column: str, most_bytes: int | None = None) -> np.ndarray | None:
    """Bit array (uint64 words, a power of two) with the keys (hashes) of a long column, or None for more than one can hold."""
    n = keys.count()
    most = (most_bytes or MOST_BYTES) // 8
    if n * LEAST_BITS > most * 64:
        return None
    words = 1 << max(4, min(most.bit_length() - 1, (max(n, 1) * 16 // 64).bit_length()))
    bits = words * 64
    places = F.explode(F.array(*[F.expr(f"shiftrightunsigned({column}, {7 + 25 * i}) & {bits - 1}") for i in range(PROBES)])).alias("place")
    rows = keys.select(places).select((F.col("place") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(words, dtype=np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def maybe(filter_: np.ndarray | None, keys: np.ndarray) -> np.ndarray:
    """Mask of keys (uint64) that may be in the filter; never False for a key that is. Without a filter all may be."""
    ok = np.ones(len(keys), dtype=bool)
    if filter_ is None:
        return ok
    last = np.uint64(len(filter_) * 64 - 1)
    for i in range(PROBES):
        place = (keys >> np.uint64(7 + 25 * i)) & last
        ok &= (filter_[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) != 0
    return ok
