"""Words: maximal runs of characters other than space, tab, line feed, vertical tab, form feed, carriage return."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetops.llm.runtime import process_cache

GAP = r"[ \t\n\x0B\f\r]+"

# An odd multiplier has an inverse modulo 2**64, so a run's hash does not depend on where it stands.
BASE = 0x9E3779B97F4A7C15
OTHER_BASE = 0xC2B2AE3D27D4EB4F
# Sums modulo 2**64 are blind to some texts of a thousand letters; words above so many bytes have digests.
LONG_WORD = 64


def words(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads differences over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n, kept in the worker and lengthened when needed."""
    cache = process_cache()
    known = cache.get(("powers", base))
    if known is None or len(known[0]) < n:
        size = max(n, 1 << 16) * 2
        up = np.full(size, base, dtype=np.uint64)
        down = np.full(size, pow(base, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        known = cache[("powers", base)] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return known[0][:n], known[1][:n]


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words given as UTF-8, for the same word always the same; long lists are cut into stretches."""
    out = []
    stretch = 1 << 15
    table = letter_values()
    for low in range(0, len(words), stretch):
        some = words[low : low + stretch]
        letters = np.frombuffer(b" ".join(some), dtype=np.uint8)
        sizes = np.fromiter(map(len, some), dtype=np.int64, count=len(some))
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        up, down = powers(BASE, len(letters) + 1)
        sums = np.zeros(len(letters) + 1, dtype=np.uint64)
        np.cumsum(table[letters] * up[:-1], out=sums[1:])
        hashes = mix64((sums[ends] - sums[starts]) * down[starts] + sizes.astype(np.uint64))
        for i in np.nonzero(sizes > LONG_WORD)[0].tolist():
            hashes[i] = int.from_bytes(blake2b(some[i], digest_size=8).digest(), "little")
        out.append(hashes)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def letter_values() -> np.ndarray:
    cache = process_cache()
    if "letter values" not in cache:
        cache["letter values"] = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(OTHER_BASE))
    return cache["letter values"]


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(OTHER_BASE, len(hashes))
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * up, out=sums[1:])
    return mix64((sums[size:] - sums[:n]) * down[:n])
