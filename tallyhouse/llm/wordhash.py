"""Words of many texts at once, as 64-bit hashes: numpy passes over code points, no loop over words."""

from __future__ import annotations

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_kept: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First ``n`` powers of the base and of its inverse, modulo 2^64."""
    if "up" not in _kept or len(_kept["up"]) < n:
        for name, base in (("up", _P), ("down", _P_INV)):
            out = np.full(n, base, dtype=np.uint64)
            out[0] = 1
            _kept[name] = np.cumprod(out, dtype=np.uint64)
    return _kept["up"][:n], _kept["down"][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _P
    return x ^ (x >> np.uint64(32))


def letters() -> np.ndarray:
    """Whether a code point below 2^16 is a letter or digit."""
    if "letters" not in _kept:
        _kept["letters"] = np.array([chr(i).isalnum() for i in range(1 << 16)])
    return _kept["letters"]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by a line feed, and where each text begins and the last ends."""
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return codes, np.cumsum([0, *[len(t) + 1 for t in texts]])


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any range follows: (sums[end] - sums[start]) * down[start]."""
    out = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers(len(codes) + 8)[0][: len(codes)], out=out[1:])
    return out


def word_spans(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of letters and digits."""
    word = letters()[np.minimum(codes, 0xFFFF)] | (codes > 0xFFFF)
    edge = np.flatnonzero(np.diff(word.astype(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-case word, and for each text where its words begin (and the last text's end)."""
    codes, begin = code_points([t.lower() for t in texts])
    start, end = word_spans(codes)
    total, down = prefix_sums(codes), powers(len(codes) + 8)[1]
    return mixed((total[end] - total[start]) * down[start]), np.searchsorted(start, begin)


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``k`` words within a text, and its text; a text of fewer words is one run."""
    n = np.diff(bounds)
    size = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    own = np.repeat(np.arange(len(n)), size)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(bounds[:-1], size)
    end = bounds[1:][own]
    out = np.zeros(len(at), dtype=np.uint64)
    for i in range(k):
        # A word that a short text lacks counts as 0.
        inside = at + i < end
        word = np.where(inside, hashes[np.minimum(at + i, max(len(hashes) - 1, 0))], np.uint64(0)) if len(hashes) else out
        out = out * _P + word
    return mixed(out), own
