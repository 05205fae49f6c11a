"""Noise from the operating system's entropy, sampled exactly in rationals (Canonne, Kamath and Steinke, 2020)."""

from __future__ import annotations

import math
import secrets
from dataclasses import dataclass
from enum import Enum
from fractions import Fraction
from math import isqrt

#: Real-valued noise moves on a grid of this part of its scale, which hides the gaps between floats (Mironov, 2012).
GRID = 20


class CountMechanism(Enum):
    DEFAULT = "default"
    LAPLACE = "laplace"
    GAUSSIAN = "gaussian"


class CountDistinctMechanism(Enum):
    DEFAULT = "default"
    LAPLACE = "laplace"
    GAUSSIAN = "gaussian"


class SumMechanism(Enum):
    DEFAULT = "default"
    LAPLACE = "laplace"
    GAUSSIAN = "gaussian"


class AverageMechanism(Enum):
    DEFAULT = "default"
    LAPLACE = "laplace"
    GAUSSIAN = "gaussian"


class VarianceMechanism(Enum):
    DEFAULT = "default"
    LAPLACE = "laplace"
    GAUSSIAN = "gaussian"


class StdevMechanism(Enum):
    DEFAULT = "default"
    LAPLACE = "laplace"
    GAUSSIAN = "gaussian"


class NoiseMechanism(Enum):
    GEOMETRIC = "geometric"
    LAPLACE = "laplace"
    DISCRETE_GAUSSIAN = "discrete_gaussian"
    GAUSSIAN = "gaussian"
    EXPONENTIAL = "exponential"
    NONE = "none"


def _chance(p: Fraction) -> bool:
    return secrets.randbelow(p.denominator) < p.numerator


def exp_chance(x: Fraction) -> bool:
    """True with probability exp(-x), x not negative."""
    while x > 1:
        if not exp_chance(Fraction(1)):
            return False
        x -= 1
    k = 1
    while _chance(x / k):
        k += 1
    return k % 2 == 1


def discrete_laplace(scale: Fraction) -> int:
    """k with probability in proportion to exp(-|k| / scale)."""
    if scale == 0:
        return 0
    t, s = scale.numerator, scale.denominator
    while True:
        u = secrets.randbelow(t)
        if not exp_chance(Fraction(u, t)):
            continue
        v = 0
        while exp_chance(Fraction(1)):
            v += 1
        size, negative = (u + t * v) // s, secrets.randbelow(2)
        if size or not negative:
            return -size if negative else size


def discrete_gaussian(variance: Fraction) -> int:
    """k with probability in proportion to exp(-k^2 / (2 variance))."""
    if variance == 0:
        return 0
    t = isqrt(math.floor(variance)) + 1
    while True:
        y = discrete_laplace(Fraction(t))
        if exp_chance((abs(y) - variance / t) ** 2 / (2 * variance)):
            return y


def _power(x: Fraction) -> int:
    """The whole part of the base-2 logarithm of a positive number."""
    k = x.numerator.bit_length() - x.denominator.bit_length()
    return k if x >= Fraction(2) ** k else k - 1


def root_below(x: Fraction, bits: int = 64) -> Fraction:
    """A square root, rounded down: a budget's epsilon never grows by it."""
    shift = 2 * max(0, bits - _power(x) // 2) if x else 0
    return Fraction(isqrt(math.floor(x * 2**shift)), 2 ** (shift // 2))


@dataclass(frozen=True)
class Noise:
    """A mechanism and its parameter: the scale, or the variance of the Gaussian ones; and how far one row moves the number it is added to.

    Real numbers are summed as whole multiples of grid, so that a sum's sensitivity is exact however Spark orders it.
    """

    mechanism: NoiseMechanism
    parameter: Fraction
    per_row: Fraction = Fraction(1)

    @property
    def grid(self) -> Fraction | None:
        """The step of a real number's noise; None for whole numbers and without noise."""
        if self.parameter == 0 or self.mechanism not in (NoiseMechanism.LAPLACE, NoiseMechanism.GAUSSIAN):
            return None
        scale = _power(self.parameter) if self.mechanism is NoiseMechanism.LAPLACE else _power(self.parameter) // 2
        return Fraction(2) ** max(scale - GRID, _power(self.per_row) - 2 * GRID)

    def add(self, value):
        """A fresh draw added to a number, which is rounded to the grid if there is one."""
        if value is None or self.grid is None:
            return self.add_steps(value)
        return self.add_steps(round(Fraction(value) / self.grid))

    def add_steps(self, value):
        """A fresh draw added to a whole number: of steps of the grid, if there is one."""
        if self.parameter == 0 or value is None:
            return value
        kind, p, g = self.mechanism, self.parameter, self.grid
        if kind is NoiseMechanism.GEOMETRIC:
            return value + discrete_laplace(p)
        if kind is NoiseMechanism.DISCRETE_GAUSSIAN:
            return value + discrete_gaussian(p)
        # a row's rounding moves its steps to the next whole one at most
        steps = Fraction(math.floor(self.per_row / g) + 1) / self.per_row
        k = discrete_laplace(p * steps) if kind is NoiseMechanism.LAPLACE else discrete_gaussian(p * steps**2)
        return float((int(value) + k) * g)

    def info(self) -> dict:
        return {"noise_mechanism": self.mechanism, "noise_parameter": float(self.parameter)}


def gumbel() -> float:
    u = (secrets.randbits(53) + 0.5) / (1 << 53)
    return -math.log(-math.log(u))


def uniform() -> float:
    return secrets.randbits(53) / (1 << 53)
