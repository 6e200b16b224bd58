"""A Bloom filter over 64-bit keys, built in Spark and used inside Arrow passes to preselect rows of a join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a filter (fixed, so the filter takes 2 MB however many keys it has; a full one lets more rows through, never fewer), and probes.
BITS, PROBES = 1 << 24, 3


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def probes(keys: np.ndarray) -> Iterator[np.ndarray]:
    """The bits of each key, one array a probe (double hashing)."""
    x = mix(keys)
    step = (x >> np.uint64(33)) | np.uint64(1)
    with np.errstate(over="ignore"):
        for i in range(PROBES):
            yield ((x + np.uint64(i) * step) & np.uint64(BITS - 1)).astype(np.int64)


def build(keys: DataFrame, key: str) -> np.ndarray:
    """The filter of the long column ``key``. Bits are joined in Spark: at most ``BITS / 64`` rows of 16 bytes reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITS // 64, dtype=np.uint64)
        for b in batches:
            for at in probes(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)):
                np.bitwise_or.at(bits, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        slots = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(bits[slots].view(np.int64), pa.int64())], names=["slot", "bits"])

    rows = keys.select(F.col(key).cast("long")).filter(F.col(key).isNotNull()).mapInArrow(run, "slot long, bits long")
    rows = rows.groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, dtype=np.uint64)
    out[rows.column("slot").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def holds(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the filter."""
    hit = np.ones(len(keys), dtype=bool)
    for at in probes(keys):
        hit &= (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
    return hit
