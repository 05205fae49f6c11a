"""Bins of numbers, dates, timestamps or strings."""

from __future__ import annotations

import datetime
import math
from bisect import bisect_left, bisect_right
from itertools import pairwise

from pyspark.sql import functions as F

from ..types import ColumnDescriptor, ColumnType

#: Bins up to which a value's bin is a chain of conditions; more are searched by halves.
CHAINED = 32


#: Units that a timestamp's name can end in, with their microseconds, the coarsest first.
UNITS = (("minutes", 60_000_000), ("seconds", 1_000_000), ("milliseconds", 1_000), ("microseconds", 1))


def _label(edge, digits: int, unit: str) -> str:
    if isinstance(edge, float):
        return f"{edge:.{digits}f}"
    if isinstance(edge, str):
        return repr(edge)
    if isinstance(edge, datetime.datetime):
        return edge.isoformat(sep=" ", timespec=unit)
    return str(edge)


def _unit(edges) -> str:
    """The coarsest unit that tells every timestamp exactly."""
    past_minute = [e.second * 1_000_000 + e.microsecond for e in edges if isinstance(e, datetime.datetime)]
    return next(name for name, size in UNITS if not any(x % size for x in past_minute))


def _array(values: list, kind: str):
    """An array of constants. Numbers and strings go to Spark as one text, as thousands of literals take longer to build than to use."""
    mark = "\x01"
    if all(type(v) in (int, float, str) for v in values) and not any(isinstance(v, str) and mark in v for v in values):
        return F.split(F.lit(mark.join(map(str, values))), mark).cast(f"array<{kind}>")
    return F.array(*(F.lit(v).cast(kind) for v in values))


class BinningSpec:
    """Bins between ascending edges, and the name of the bin of a value.

    Bins hold their right edge (or their left one), and the outermost edge on the other side too if
    include_both_endpoints. Values in no bin, and null, have no bin; NaN has nan_bin.
    """

    def __init__(self, bin_edges, names=None, right: bool = True, include_both_endpoints: bool = True, nan_bin=None):
        edges = [e.item() if hasattr(e, "item") else e for e in bin_edges]
        if len(edges) < 2:
            raise ValueError("there have to be at least two bin edges")
        kinds = {type(e) for e in edges}
        if kinds == {int, float}:
            edges, kinds = [float(e) for e in edges], {float}
        if len(kinds) > 1:
            raise ValueError("bin edges have to be of one type")
        self.input_type = next((k for k in (ColumnType.INTEGER, ColumnType.DECIMAL, ColumnType.VARCHAR, ColumnType.DATE, ColumnType.TIMESTAMP) if k.value in kinds), None)
        if self.input_type is None:
            raise ValueError(f"bin edges can't be of type {kinds.pop().__name__}")
        if self.input_type is ColumnType.DECIMAL and any(math.isnan(e) for e in edges):
            raise ValueError("a bin edge may not be NaN")
        if any(a >= b for a, b in pairwise(edges)):
            raise ValueError("bin edges have to ascend strictly")
        if nan_bin is not None and self.input_type not in (ColumnType.DECIMAL, ColumnType.INTEGER):
            raise ValueError("only bins of numbers have a bin for NaN")
        self.edges, self.right, self.both, self.nan_bin = edges, right, include_both_endpoints, nan_bin
        names = self._default_names() if names is None else [n.item() if hasattr(n, "item") else n for n in names]
        if len(names) != len(edges) - 1:
            raise ValueError(f"{len(edges) - 1} bins have {len(names)} names")
        if any(n is None for n in names):
            raise ValueError("a bin name may not be None")
        self.names = names
        every = [*names, *([] if nan_bin is None else [nan_bin])]
        named = {float if {type(x) for x in every} == {int, float} else type(x) for x in every}
        if len(named) > 1:
            raise ValueError("bin names have to be of one type")
        kind = named.pop()
        self.output_type = next((k for k in (ColumnType.VARCHAR, ColumnType.INTEGER, ColumnType.DECIMAL, ColumnType.TIMESTAMP, ColumnType.DATE) if k.value is kind), None)
        if self.output_type is None:
            raise ValueError(f"bin names can't be of type {kind.__name__}")

    def _default_names(self) -> list[str]:
        unit = _unit(self.edges)
        for digits in range(2, 17):
            shown = [_label(e, digits, unit) for e in self.edges]
            if len(set(shown)) == len(shown) or self.input_type is not ColumnType.DECIMAL:
                break
        last = len(shown) - 2
        out = []
        for i, (a, b) in enumerate(pairwise(shown)):
            left = "[" if not self.right or (self.both and i == 0) else "("
            right = "]" if self.right or (self.both and i == last) else ")"
            out.append(f"{left}{a}, {b}{right}")
        return out

    def bins(self, include_null: bool = False) -> list:
        """The names of the bins, each once, that of NaN last, and None if include_null."""
        every = [*self.names, *([] if self.nan_bin is None else [self.nan_bin]), *([None] if include_null else [])]
        return list(dict.fromkeys(every))

    def descriptor(self) -> ColumnDescriptor:
        floats = [x for x in self.bins() if isinstance(x, float)]
        return ColumnDescriptor(self.output_type, True, any(map(math.isnan, floats)), any(map(math.isinf, floats)))

    def column(self, value):
        """The bin of a Spark column: a chain of conditions for few bins, a binary search of the edges for many."""
        kind = self.output_type.spark
        out = self._chained(value, kind) if len(self.names) <= CHAINED else self._searched(value, kind)
        if self.input_type in (ColumnType.DECIMAL, ColumnType.INTEGER):
            out = F.when(F.isnan(value), F.lit(self.nan_bin).cast(kind)).otherwise(out)
        return out

    def _chained(self, value, kind):
        out, last = F.lit(None).cast(kind), len(self.names) - 1
        for i in range(last, -1, -1):
            a, b = F.lit(self.edges[i]), F.lit(self.edges[i + 1])
            above = value >= a if not self.right or (self.both and i == 0) else value > a
            below = value <= b if self.right or (self.both and i == last) else value < b
            out = F.when(above & below, F.lit(self.names[i]).cast(kind)).otherwise(out)
        return out

    def _searched(self, value, kind):
        edges, n = _array(self.edges, self.input_type.spark.simpleString()), len(self.edges)
        steps = F.array(*(F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)))

        def further(at, step):
            edge = F.get(edges, at + step - 1)
            return F.when((at + step <= n) & (edge < value if self.right else edge <= value), at + step).otherwise(at)

        # how many edges lie under the value
        under = F.aggregate(steps, F.lit(0), further)
        if self.both:
            under = F.when(value == F.lit(self.edges[0]), 1).when(value == F.lit(self.edges[-1]), n - 1).otherwise(under)
        return F.when(value.isNotNull() & (under < n), F.get(_array(self.names, kind.simpleString()), under - 1))

    def __call__(self, value):
        """The bin of a Python value."""
        if value is None:
            return None
        if isinstance(value, float) and math.isnan(value):
            return self.nan_bin
        if self.both and value in (self.edges[0], self.edges[-1]):
            return self.names[0 if value == self.edges[0] else -1]
        under = (bisect_left if self.right else bisect_right)(self.edges, value)
        return self.names[under - 1] if 0 < under < len(self.edges) else None

    def _key(self):
        return tuple(self.edges), tuple(self.names), self.right, self.both, self.nan_bin

    def __eq__(self, other) -> bool:
        return isinstance(other, BinningSpec) and self._key() == other._key()

    def __hash__(self) -> int:
        return hash(self._key())
