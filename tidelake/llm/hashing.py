"""Word spans and 64-bit word hashes of whole batches of texts, in numpy.

A chunk of texts is one byte array; a word's hash is the difference of two prefix sums of a polynomial modulo 2**64,
shifted to the origin and finalised, so that the cost per byte doesn't depend on the length of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
BASE = 0x9E3779B97F4A7C15 | 1
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def _byte_values(seed: int, fold: bool) -> np.ndarray:
    at = np.arange(256, dtype=np.uint64)
    if fold:
        at[65:91] += U(32)
    with np.errstate(over="ignore"):
        return mix(at * U(0xD1342543DE82EF95) + U(seed))


class Hasher:
    """Hashes words; ``fold`` takes A-Z as a-z. Two seeds give independent hashes."""

    def __init__(self, fold: bool = False, seed: int = 1):
        self.values, self.seed = _byte_values(seed, fold), seed
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) <= n:
            n = max(n, 2 * CHUNK)
            for name, base in (("power", BASE), ("inverse", pow(BASE, -1, 1 << 64))):
                x = np.full(n + 1, U(base))
                x[0] = U(1)
                setattr(self, name, np.multiply.accumulate(x))

    def spans(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(buf))
        sums = np.zeros(len(buf) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(self.values[buf] * self.power[: len(buf)], out=sums[1:])
            h = (sums[ends] - sums[starts]) * self.inverse[starts]
            return mix(h + (ends - starts).astype(np.uint64) * U(0xA24BAED4963EE407))


def texts_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 of each text; a null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()] if len(column) else []


def chunks(texts: list[bytes], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``most`` bytes together; a longer text is alone."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield at, i
            at, held = i, 0
        held += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, word starts, word ends, first word of each text and the number of words at last)."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    inside = np.zeros(len(buf) + 1, np.int8)
    inside[1:] = ~SEPARATOR[buf]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    text_at = np.cumsum([0] + [len(t) + 1 for t in texts])
    return buf, starts, ends, np.searchsorted(starts, text_at)


def rolling(h: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """Hash of each k consecutive values (len - k + 1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = (0xC2B2AE3D27D4EB4F + 2 * seed) | 1
    with np.errstate(over="ignore"):
        if k <= 8:
            out = np.zeros(n, np.uint64)
            for j in range(k):
                out = out * U(base) + h[j : j + n]
            return mix(out)
        x = np.full(len(h) + 1, U(base))
        x[0] = U(1)
        power = np.multiply.accumulate(x)
        x[1:] = U(pow(base, -1, 1 << 64))
        inverse = np.multiply.accumulate(x)
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * power[:-1], out=sums[1:])
        return mix((sums[k:] - sums[:-k]) * inverse[:n])
