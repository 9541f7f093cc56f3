"""Counts of tokens over all documents in hashed slots of fixed number.

A map task sends its slots as compressed blocks; blocks are summed by key, and each sum
becomes one byte, its class. The classes reach the driver and go out again: a byte a
slot, whatever the input's size. Slots order tokens; they decide nothing that must be exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .text import mix, tidy

BLOCK = 1 << 14


def slot(token: np.ndarray, slots: int) -> np.ndarray:
    return (mix(token) & np.uint64(slots - 1)).astype(np.int64)


def block_rows(counts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Numbers and bodies of a task's blocks."""
    n = len(counts) // BLOCK if counts.any() else 0
    bodies = [zstandard.ZstdCompressor(1).compress(c.tobytes()) for c in counts.reshape(-1, BLOCK)[:n]]
    return pa.array(range(n), pa.int32()), pa.array(bodies, pa.binary())


def tally(counts: np.ndarray, slots: np.ndarray) -> None:
    """Adds 1 for each slot given."""
    if len(slots) * 8 < len(counts):
        np.add.at(counts, slots, np.uint32(1))
    else:
        counts += np.bincount(slots, minlength=len(counts)).astype(np.uint32)


def _classes(ordinary: float | None):
    """Sums the blocks of a partition; a row of classes for each block in it."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, body in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                mine = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint32)
                total[block] = total[block] + mine if block in total else mine.astype(np.int64)
        for block, counts in total.items():
            counts = np.maximum(counts, 1)
            classes = np.round(4 * np.log2(counts)) if ordinary is None else np.ceil(np.log2(counts / ordinary))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.clip(classes, 0, 255).astype(np.uint8).tobytes()], pa.binary())], ["block", "classes"])

    return run


def classes_of(rows: DataFrame, slots: int, tokens: int | None = None) -> np.ndarray:
    """A rarity class for each slot from the rows that have a block: by quarters of a power
    of two of its count; or, where the number of all ``tokens`` is given, 0 for a count
    that chance explains (their mean and some deviations), then by powers of two."""
    mean = None if tokens is None else tokens / slots
    ordinary = None if mean is None else mean + 6 * mean**0.5 + 4
    out = np.zeros((slots // BLOCK, BLOCK), np.uint8)
    summed = rows.where("block is not null").select("block", "counts").repartition(min(slots // BLOCK, 32), "block").mapInArrow(_classes(ordinary), "block int, classes binary")
    for b in summed.collect():  # a byte a slot
        out[b["block"]] = np.frombuffer(b["classes"], np.uint8)
    return out.ravel()
