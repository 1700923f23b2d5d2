"""Hashes of words and word runs over whole batches of texts at once, in numpy."""

from __future__ import annotations

import numpy as np

_MADE = np.random.default_rng(20240229)
OF_BYTE = _MADE.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Bytes hashed at once: the temporary arrays take about 50 times this.
STEP = 1 << 20
#: A-Z to lower case and white space to blanks, byte by byte: UTF-8's other bytes stay.
FOLD = bytes(32 if b in (9, 10, 11, 12, 13) else b + 32 if 65 <= b <= 90 else b for b in range(256))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, STEP + (STEP >> 2))
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _hash_step(blobs: list[bytes], drop: bytes) -> tuple[np.ndarray, np.ndarray]:
    folded = [b.translate(FOLD, drop) for b in blobs]
    data = np.frombuffer(b" ".join(folded) + b" ", np.uint8)
    begin = np.zeros(len(folded) + 1, np.int64)
    np.cumsum([len(b) + 1 for b in folded], out=begin[1:])
    blank = data == 32
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    up, down = powers(len(data))
    run = np.cumsum(OF_BYTE[data] * up, dtype=np.uint64)
    h = run[end - 1]
    h -= np.where(start > 0, run[start - 1], np.uint64(0))
    h *= down[start]
    return mix(h + (end - start).astype(np.uint64)), np.searchsorted(start, begin)


def word_hashes(blobs: list[bytes], drop: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and the place of each text's first word (one more at the end).

    Words are runs of bytes other than white space, A-Z in lower case, bytes of ``drop`` left out.
    """
    found, at, held = [], [np.zeros(1, np.int64)], 0
    group: list[bytes] = []
    weight = 0
    for i, b in enumerate(blobs):
        group.append(b)
        weight += len(b) + 1
        if weight >= STEP or i == len(blobs) - 1:
            h, offsets = _hash_step(group, drop)
            found.append(h)
            at.append(offsets[1:] + held)
            held += len(h)
            group, weight = [], 0
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), np.concatenate(at).astype(np.int64)


def runs(h: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """At each position, a hash of the words at the mask's offsets (the array is shorter by the span less one)."""
    span = mask[-1] + 1
    n = max(0, len(h) - span + 1)
    out = np.zeros(n, np.uint64)
    for k in mask:
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[k : k + n]
        out ^= out >> np.uint64(29)
    return mix(out)


def shingles(h: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word runs; a text with fewer words has its whole sequence as one run."""
    all_runs = runs(h, tuple(range(k)))
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(all_runs[a : b - k + 1]))
        elif b > a:
            out.append(runs(h[a:b], tuple(range(int(b - a)))) ^ np.uint64(int(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
