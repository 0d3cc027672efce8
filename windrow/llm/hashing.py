"""Hashes of words and n-grams of many texts at once, in numpy arrays over their code points."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Bases of the polynomial hashes modulo 2 ** 64 (odd, so they have inverses) and modulo PRIME, for two independent
#: functions; and characters handled at once. The prime is there because some pairs of long words (those of Thue
#: and Morse) agree under every polynomial modulo a power of two.
BASES, PRIME_BASES, PRIME, CHARS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (7_368_787, 10_000_019), 16_777_213, 250_000
#: Terms below 2 ** 45 that 64 bits can add up.
ADDED = 1 << 18


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def prime_powers(base: int, count: int) -> np.ndarray:
    out = np.ones(count, np.uint64)
    done = 1
    while done < count:
        more = min(done, count - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, PRIME)) % np.uint64(PRIME)
        done += more
    return out


_tables: dict[int, tuple[np.ndarray, ...]] = {}


def _powers(count: int, seed: int) -> tuple[np.ndarray, ...]:
    """Powers and inverse powers of a function's two bases, for the largest count asked for up to a bound; beyond it they aren't kept."""
    held = _tables.get(seed)
    if held is None or len(held[0]) < count:
        size = max(count, CHARS + CHARS // 4)
        base, other = BASES[seed], PRIME_BASES[seed]
        held = powers(base, size), powers(pow(base, -1, 1 << 64), size), prime_powers(other, size), prime_powers(pow(other, -1, PRIME), size)
        if size <= 8 * CHARS:
            _tables[seed] = held
    return held


def groups(texts: list[str], chars: int = CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about so many characters together; a longer text has a range of its own."""
    begin = total = 0
    for i, text in enumerate(texts):
        if i > begin and total + len(text) > chars:
            yield begin, i
            begin, total = i, 0
        total += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts)


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, a space after each; where each text begins, and the end."""
    codes = np.frombuffer((" ".join(texts) + " ").encode("utf-32-le"), np.uint32)
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
    return codes, begins


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
    return edges[::2], edges[1::2]


class Spans:
    """Hashes of any stretches of one array of code points, from sums over its prefixes; ``seed`` chooses the function."""

    def __init__(self, codes: np.ndarray, seed: int = 0):
        power, self.inverse, small, self.small_inverse = _powers(len(codes) + 1, seed)
        values = codes.astype(np.uint64) + np.uint64(1)
        self.sums, self.small_sums = np.zeros((2, len(codes) + 1), np.uint64)
        np.cumsum(values * power[: len(codes)], out=self.sums[1:])
        values *= small[: len(codes)]
        if len(codes) > ADDED:
            values %= np.uint64(PRIME)
        np.cumsum(values, out=self.small_sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        small = (self.small_sums[ends] - self.small_sums[starts]) % np.uint64(PRIME) * self.small_inverse[starts] % np.uint64(PRIME)
        whole = (self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64)
        return mixed(whole + mixed(small))


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
