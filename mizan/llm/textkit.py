"""Vectorised work on whole Arrow columns of text: words, their hashes, and
shingles, over the UTF-8 bytes without a Python object for each word."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; a longer text is taken alone.
CHUNK = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0xD1342543DE82EF95
_powers: list[np.ndarray] = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


#: What a module keeps in a worker between tasks, as functions that drop it.
CACHES: dict[str, Callable[[], None]] = {}


def entered(module: str) -> None:
    """A task of ``module`` begins: what other modules keep here goes."""
    for name, drop in CACHES.items():
        if name != module:
            drop()


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches before which the Python worker, which lives on,
    drops what tasks of other modules left, and after which it gives the memory
    that it no longer uses back to the system."""
    module = run.__module__

    @functools.wraps(run)
    def inner(batches: Iterator) -> Iterator:
        from mizan.llm import textkit  # the worker's own, not a copy of its names

        textkit.entered(module)
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
                trim(0)

    return inner


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def narrow(x: np.ndarray) -> bytes:
    """Numbers from 0 up, in as few bytes each as the largest needs."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0)))).tobytes()


def widened(blob: bytes, n: int) -> np.ndarray:
    """What ``narrow`` made of ``n`` numbers."""
    return np.frombuffer(blob, f"u{len(blob) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2 ** 64."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[i] = np.multiply.accumulate(table)
    return _powers


def chunks(texts: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts: first row, their bytes, and offsets into the bytes."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and where each text's words begin."""
    inside = ~_SPACE[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.roll(inside, 1) & ~edge[:-1], np.roll(inside, -1) & ~edge[1:]
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, offsets, "left")


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each word's bytes; with ``lower``, A-Z count as a-z."""
    if not len(start):
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(data) + 1)
    values = (_LOWER[data] if lower else data).astype(np.uint64)
    values += np.uint64(1)
    values *= power[: len(data)]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    h = (total[end] - total[start]) * inverse[start]
    return mix(h + _ODD * (end - start).astype(np.uint64))


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive values."""
    k = int(k)
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = np.full(len(h) - k + 1, np.uint64(k * int(_ODD) & 0xFFFFFFFFFFFFFFFF), np.uint64)
    for i in range(k):
        out = out * np.uint64(0xF1357AEA2E62A9C5) + h[i : len(h) - k + 1 + i]
    return mix(out)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles of ``k`` lower-cased words, sorted;
    with fewer words the whole sequence is one; without words none."""
    for _, data, offsets in chunks(texts):
        start, end, bounds = words(data, offsets)
        h = word_hashes(data, start, end, lower=True)
        for a, b in zip(bounds, bounds[1:]):
            yield np.unique(run_hashes(h[a:b], min(k, b - a))) if b > a else np.zeros(0, np.uint64)
