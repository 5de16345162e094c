"""Hashes of word shingles for a batch of texts, with numpy over the bytes."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = tuple(np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_powers = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1, modulo 2 ** 64."""
    kept = _powers.get(int(base))
    if kept is None or len(kept) < n:
        kept = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 19), base, np.uint64)]))
        _powers[int(base)] = kept
    return kept[:n]


def word_hashes(texts: list[str | bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts (strings, or their UTF-8), A-Z lower-cased, in order, and the number of words of each text."""
    raw = [(t if isinstance(t, bytes) else (t or "").encode("utf-8", "surrogatepass")).lower() for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    data = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    starts, stops = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_P, len(data)))])
        h = (total[stops] - total[starts]) * _power(_INVERSE, len(data) + 1)[starts]
        h = mix(h + (stops - starts).astype(np.uint64) * _MIX[1])
    return h, np.diff(np.searchsorted(starts, np.concatenate([[0], ends])))


def shingle_sets(texts: list[str | bytes | None], width: int = 5, chunk: int = 1 << 18) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``width`` words; of its whole sequence if it has fewer words."""
    out, some, size = [], [], 0
    for t in texts:
        some.append(t)
        size += len(t or "")
        if size >= chunk:
            out += _sets(some, width)
            some, size = [], 0
    return out + _sets(some, width) if some else out


def _sets(texts: list[str | bytes | None], width: int) -> list[np.ndarray]:
    h, counts = word_hashes(texts)
    odd = _power(np.uint64(0xD1342543DE82EF95), width + 1)[1:]
    with np.errstate(over="ignore"):
        n = max(0, len(h) - width + 1)
        rolled = np.zeros(n, np.uint64)
        for j in range(width):
            rolled += h[j : j + n] * odd[j]
        rolled = mix(rolled)
        out, at = [], 0
        for c in counts.tolist():
            if c >= width:
                out.append(np.unique(rolled[at : at + c - width + 1]))
            else:
                out.append(mix((h[at : at + c] * odd[:c]).sum(dtype=np.uint64, keepdims=True) + np.uint64(c)) if c else np.zeros(0, np.uint64))
            at += c
    return out
