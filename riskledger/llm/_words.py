"""Hashes of the words of an Arrow batch of texts, read from its own buffers."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_P = 0x9E3779B97F4A7C15 | 1
_INV = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
SLICE_BYTES, KEPT_POWERS = 1_000_000, 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True


def trim() -> None:
    """Give freed memory back to the system (where the C library can): workers live on between stages."""
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit hashes (uint64) over all bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _power(base: int, n: int) -> np.ndarray:
    """Powers of base; those up to a slice's usual size are kept."""
    have = _powers.get(base)
    if have is None or have.size < n:
        have = np.full(max(n, KEPT_POWERS), base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if have.size == KEPT_POWERS:
            _powers[base] = have
    return have[:n]


def powers(n: int) -> np.ndarray:
    """The hash base to the powers 0 to n - 1, modulo 2^64."""
    return _power(_P, n)


def inverse_powers(n: int) -> np.ndarray:
    return _power(_INV, n)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about most_bytes of text each; a longer text is alone."""
    if not batch.num_rows:
        return
    text = batch[column]
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    start = 0
    while start < len(text):
        end = int(np.searchsorted(offsets, offsets[start] + most_bytes, "right")) - 1
        end = min(max(end, start + 1), len(text))
        yield batch.slice(start, end - start)
        start = end


@dataclass
class Words:
    """The words of a batch in order: 64-bit hash (ASCII lower-cased), row, first byte and byte after the last, in raw."""

    hash: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    raw: np.ndarray


def running_hash(raw: np.ndarray) -> np.ndarray:
    """Sums of the bytes times powers of the hash base, before each byte and after the last; computed in place."""
    total = np.zeros(raw.size + 1, np.uint64)
    part = total[1:]
    part += raw
    part += np.uint64(1)
    part *= powers(raw.size)
    np.cumsum(part, out=part)
    return total


def word_hashes(text: pa.StringArray) -> Words:
    """All words of the texts; null texts have none."""
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64) if len(text) else np.zeros(1, np.int64)
    none = np.zeros(0, np.int64)
    if offsets[-1] == offsets[0]:
        return Words(none.astype(np.uint64), none, none, none, none.astype(np.uint8))
    raw = np.frombuffer(text.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    space = SPACES[raw]
    n = raw.size
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[True], space[:-1]]) | edge[:-1]
    after = np.concatenate([space[1:], [True]]) | edge[1:]
    start, end = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    total = running_hash(_LOWER[raw])
    h = mix((total[end] - total[start]) * inverse_powers(n)[start] + (end - start).astype(np.uint64))
    return Words(h, np.searchsorted(offsets, start, "right") - 1, start, end, raw)


def shingle_hashes(text: pa.StringArray, k: int) -> Iterator[np.ndarray]:
    """For each row its sorted distinct k-word shingles as hashes; a text with fewer
    words has its whole sequence as one, a text without words none."""
    w = word_hashes(text)
    h, row = w.hash, w.row
    count = np.bincount(row, minlength=len(text)) if row.size else np.zeros(len(text), np.int64)
    ends = np.cumsum(count)
    a = np.uint64(0xD6E8FEB86659FD93)
    every = np.zeros(max(h.size - k + 1, 0), np.uint64)
    for j in range(k):
        every = every * a + h[j : j + every.size]
    every = mix(every)
    for c, e in zip(count.tolist(), ends.tolist()):
        if c >= k:
            yield np.unique(every[e - c : e - k + 1])
        elif c:
            s = np.uint64(c)
            for x in h[e - c : e]:
                with np.errstate(over="ignore"):
                    s = s * a + x
            yield mix(np.array([s ^ np.uint64(0x5555555555555555)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
