"""The documented 48-bit linear congruential generator of java.util.Random, where results depend on its draws."""

from __future__ import annotations

import math

import numpy as np


class JavaRandom:
    def __init__(self, seed: int) -> None:
        self.state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)
        self.spare: float | None = None

    def bits(self, n: int) -> int:
        """The n top bits of the next state, as a signed number of 32 bits."""
        self.state = (self.state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        out = self.state >> (48 - n)
        return out - (1 << 32) if n == 32 and out >= 1 << 31 else out

    def next_int(self, bound: int) -> int:
        if bound & -bound == bound:
            return (bound * self.bits(31)) >> 31
        while True:
            drawn = self.bits(31)
            if drawn - drawn % bound + bound - 1 < 1 << 31:
                return drawn % bound

    def next_double(self) -> float:
        return ((self.bits(26) << 27) + self.bits(27)) / (1 << 53)

    def next_gaussian(self) -> float:
        if self.spare is not None:
            out, self.spare = self.spare, None
            return out
        while True:
            a, b = 2 * self.next_double() - 1, 2 * self.next_double() - 1
            s = a * a + b * b
            if 0 < s < 1:
                m = math.sqrt(-2 * math.log(s) / s)
                self.spare = b * m
                return a * m


class JavaRandoms:
    """Many such generators side by side."""

    def __init__(self, seeds: np.ndarray) -> None:
        self.state = ((seeds.astype(np.int64) ^ 0x5DEECE66D) & ((1 << 48) - 1)).view(np.uint64)

    def _bits(self, on: np.ndarray, n: int) -> np.ndarray:
        self.state[on] = (self.state[on] * np.uint64(0x5DEECE66D) + np.uint64(0xB)) & np.uint64((1 << 48) - 1)
        return self.state[on] >> np.uint64(48 - n)

    def next_double(self, on: np.ndarray) -> np.ndarray:
        """The next number of those generators."""
        high = self._bits(on, 26) << np.uint64(27)
        return (high + self._bits(on, 27)) / float(1 << 53)
