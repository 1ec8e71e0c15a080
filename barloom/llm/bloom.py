"""Bloom filters of 64-bit keys with a bounded size, safe to broadcast.

A filter too full lets more keys through and never loses one; who uses it checks exactly afterwards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barloom.llm import wordhash
from barloom.llm.common import dropping_shuffles

#: A filter has at least 2**16 bits and at most these, 16 MB.
MOST_BITS = 1 << 27
SLICE = 1 << 16


def _probes(keys: np.ndarray, bits: int) -> np.ndarray:
    mixed = wordhash.mix(keys.view(np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    mask = np.uint64(bits - 1)
    return np.stack([mixed & mask, (mixed >> np.uint64(21)) & mask, (mixed >> np.uint64(37)) & mask]).astype(np.int64)


def maybe_in(keys: np.ndarray, bloom: np.ndarray) -> np.ndarray:
    at = _probes(keys, len(bloom) * 8)
    return ((bloom[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(0)


def bits_for(n: int) -> int:
    """Bits for n keys: sixteen each, a power of two, within the bounds."""
    return 1 << min(MOST_BITS.bit_length() - 1, max(16, (16 * n).bit_length()))


def build_blooms(keys: DataFrame, bits: int, filters: int = 1) -> list[np.ndarray]:
    """`filters` filters from the (which, key) rows; tasks send slices of bits, which are merged slice by slice."""
    size = bits // 8

    def partial(batches):
        blooms = np.zeros((filters, size), np.uint8)
        for batch in batches:
            which, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k in range(filters):
                at = _probes(key[which == k], bits).ravel()
                np.bitwise_or.at(blooms[k], at >> 3, (1 << (at & 7)).astype(np.uint8))
        parts = blooms.reshape(-1, min(size, SLICE))
        some = np.flatnonzero(parts.any(1))
        yield pa.record_batch([pa.array(some), pa.array([parts[i].tobytes() for i in some], pa.binary())], names=["slice", "bits"])

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(min(size, SLICE), np.uint8)
        for piece in table["bits"]:
            total |= np.frombuffer(piece.as_py(), np.uint8)
        return pa.table({"slice": table["slice"][:1], "bits": pa.array([total.tobytes()], pa.binary())})

    with dropping_shuffles(keys.sparkSession):
        parts = keys.select("*").mapInArrow(partial, "slice long, bits binary")
        rows = parts.groupBy("slice").applyInArrow(merge, "slice long, bits binary").collect()
    blooms = np.zeros((filters * size // min(size, SLICE), min(size, SLICE)), np.uint8)
    for at, piece in rows:
        blooms[at] = np.frombuffer(piece, np.uint8)
    return list(blooms.reshape(filters, size))
