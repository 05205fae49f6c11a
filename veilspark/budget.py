"""Privacy budgets in exact rationals."""

from __future__ import annotations

import math
from fractions import Fraction
from numbers import Rational

#: A request may exceed what remains by this part of it, and is then rounded down to what remains.
TOLERANCE = Fraction(1, 10**9)
INF = math.inf
Amount = Fraction | float


def _amount(value, name: str) -> Amount:
    if isinstance(value, bool) or not isinstance(value, (int, float, Rational)):
        raise TypeError(f"{name} has to be a number, not {type(value).__name__}")
    if isinstance(value, float) and math.isnan(value):
        raise ValueError(f"{name} may not be NaN")
    if value < 0:
        raise ValueError(f"{name} may not be negative")
    return INF if value == INF else Fraction(value)


def _less(a: Amount, b: Amount, name: str) -> Amount:
    if a == INF:
        return INF
    if b == INF or b > a:
        raise ValueError(f"cannot take {name} {b} from {a}")
    return a - b


class PrivacyBudget:
    """Base of the budgets. Amounts are tuples, one number for each parameter."""

    amounts: tuple[Amount, ...]
    names: tuple[str, ...]

    @property
    def is_infinite(self) -> bool:
        return self.amounts[0] == INF

    @classmethod
    def inf(cls):
        raise NotImplementedError

    @property
    def is_zero(self) -> bool:
        return all(a == 0 for a in self.amounts)

    def _like(self, amounts):
        return type(self)(*amounts)

    def _check(self, other):
        if type(other) is not type(self):
            raise TypeError(f"a {type(self).__name__} and a {type(other).__name__} do not mix")

    def __add__(self, other):
        if isinstance(self, PureDPBudget) and isinstance(other, ApproxDPBudget):
            return ApproxDPBudget(self.amounts[0], 0) + other
        if isinstance(self, ApproxDPBudget) and isinstance(other, PureDPBudget):
            other = ApproxDPBudget(other.amounts[0], 0)
        self._check(other)
        return self._like(min(a + b, self._most(i)) for i, (a, b) in enumerate(zip(self.amounts, other.amounts)))

    def __sub__(self, other):
        if isinstance(self, ApproxDPBudget) and isinstance(other, PureDPBudget):
            other = ApproxDPBudget(other.amounts[0], 0)
        self._check(other)
        if self.is_infinite:
            return self
        return self._like(_less(a, b, n) for a, b, n in zip(self.amounts, other.amounts, self.names))

    def __mul__(self, factor):
        k = _amount(factor, "the factor")
        if k == INF:
            raise ValueError("the factor has to be finite")
        return self._like(INF if a == INF else min(a * k, self._most(i)) for i, a in enumerate(self.amounts))

    __rmul__ = __mul__

    def __truediv__(self, factor):
        k = _amount(factor, "the divisor")
        if k in (0, INF):
            raise ValueError("the divisor has to be positive and finite")
        return self._like(INF if a == INF else a / k for a in self.amounts)

    def _most(self, position: int) -> Amount:
        return INF

    def __eq__(self, other) -> bool:
        if type(other) is not type(self):
            return NotImplemented
        return (self.is_infinite and other.is_infinite) or self.amounts == other.amounts

    def __hash__(self) -> int:
        return hash((type(self), "inf" if self.is_infinite else self.amounts))

    def __repr__(self) -> str:
        return f"{type(self).__name__}({', '.join(f'{n}={float(a):g}' for n, a in zip(self.names, self.amounts))})"


class PureDPBudget(PrivacyBudget):
    names = ("epsilon",)

    def __init__(self, epsilon):
        self.amounts = (_amount(epsilon, "epsilon"),)

    @property
    def epsilon(self) -> float:
        return float(self.amounts[0])

    @classmethod
    def inf(cls):
        return cls(INF)


class ApproxDPBudget(PrivacyBudget):
    names = ("epsilon", "delta")

    def __init__(self, epsilon, delta):
        self.amounts = (_amount(epsilon, "epsilon"), _amount(delta, "delta"))
        if self.amounts[1] > 1:
            raise ValueError("delta may not be over 1")

    def _most(self, position):
        return Fraction(1) if position else INF

    @property
    def epsilon(self) -> float:
        return float(self.amounts[0])

    @property
    def delta(self) -> float:
        return float(self.amounts[1])

    @property
    def is_infinite(self) -> bool:
        return self.amounts[0] == INF or self.amounts[1] == 1

    @classmethod
    def inf(cls):
        return cls(INF, 1)


class RhoZCDPBudget(PrivacyBudget):
    names = ("rho",)

    def __init__(self, rho):
        self.amounts = (_amount(rho, "rho"),)

    @property
    def rho(self) -> float:
        return float(self.amounts[0])

    @classmethod
    def inf(cls):
        return cls(INF)


def settle(requested: PrivacyBudget, remaining: PrivacyBudget) -> PrivacyBudget:
    """What a request takes: itself, or all that remains of a parameter that it exceeds by no more than the tolerance."""
    if remaining.is_infinite:
        return requested
    return type(requested)(*(r if q != INF and r < q <= r + r * TOLERANCE else q for q, r in zip(requested.amounts, remaining.amounts)))


def affordable(requested: PrivacyBudget, remaining: PrivacyBudget) -> bool:
    return remaining.is_infinite or (not requested.is_infinite and all(q <= r for q, r in zip(requested.amounts, remaining.amounts)))
