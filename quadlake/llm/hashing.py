"""64-bit hashes of many spans of a byte buffer at once."""

from __future__ import annotations

from functools import lru_cache

_P = 0x9E3779B97F4A7C15 | 1


def mix64(x):
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(size: int):
    import numpy as np

    up, down = np.full(size, _P, dtype=np.uint64), np.full(size, pow(_P, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def span_hashes(b, start, end):
    """Hash of each b[start:end]; b is an array of bytes. Equal spans have equal hashes wherever they lie."""
    import numpy as np

    up, down = _powers(1 << max(20, len(b).bit_length()))
    total = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=total[1:])
    return mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
