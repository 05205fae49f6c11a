"""Nodes of a plan. They are immutable, compare by content, and know nothing of Spark's plans."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from ..types import ColumnDescriptor


class Function:
    """A row function that compares by its code."""

    def __init__(self, f: Callable):
        if not callable(f):
            raise TypeError("the row function has to be callable")
        self.f = f

    def _key(self):
        code = getattr(self.f, "__code__", None)
        if code is None:
            return (self.f,)
        cells = tuple(repr(c.cell_contents) for c in self.f.__closure__ or ())
        return code.co_code, repr(code.co_consts), code.co_names, cells, repr(self.f.__defaults__)

    def __eq__(self, other) -> bool:
        return isinstance(other, Function) and self._key() == other._key()

    def __hash__(self) -> int:
        return hash(self._key()[0])


@dataclass(frozen=True)
class Node:
    """Base of the nodes that give a table."""


@dataclass(frozen=True)
class Source(Node):
    source_id: str


@dataclass(frozen=True)
class Rename(Node):
    child: Node
    names: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Filter(Node):
    child: Node
    condition: str


@dataclass(frozen=True)
class Select(Node):
    child: Node
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Map(Node):
    child: Node
    function: Function
    new_columns: tuple[tuple[str, ColumnDescriptor], ...]
    augment: bool


@dataclass(frozen=True)
class FlatMap(Node):
    child: Node
    function: Function
    new_columns: tuple[tuple[str, ColumnDescriptor], ...]
    augment: bool
    grouping: bool
    max_rows: int | None


@dataclass(frozen=True)
class FlatMapByID(Node):
    child: Node
    function: Function
    new_columns: tuple[tuple[str, ColumnDescriptor], ...]


@dataclass(frozen=True)
class Bin(Node):
    child: Node
    column: str
    spec: Any
    name: str


@dataclass(frozen=True)
class JoinPrivate(Node):
    child: Node
    right: Node
    left_strategy: Any
    right_strategy: Any
    columns: tuple[str, ...] | None


@dataclass(frozen=True)
class JoinPublic(Node):
    child: Node
    public: Any
    columns: tuple[str, ...] | None
    how: str


@dataclass(frozen=True)
class ReplaceNullAndNan(Node):
    child: Node
    values: tuple[tuple[str, Any], ...]


@dataclass(frozen=True)
class ReplaceInfinity(Node):
    child: Node
    values: tuple[tuple[str, tuple], ...]


@dataclass(frozen=True)
class DropNullAndNan(Node):
    child: Node
    columns: tuple[str, ...]


@dataclass(frozen=True)
class DropInfinity(Node):
    child: Node
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Enforce(Node):
    child: Node
    constraint: Any


@dataclass(frozen=True)
class Aggregate:
    """One aggregation of a table. keys is a KeySet, or columns whose keys are found privately; names are the outputs'."""

    child: Node
    keys: Any
    kind: str
    names: tuple[str, ...]
    column: str | None = None
    columns: tuple[str, ...] | None = None
    low: Any = None
    high: Any = None
    quantile: float | None = None
    mechanism: str = "default"
    threshold: float | None = None
