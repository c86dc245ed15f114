"""The expression tree.  Nodes are values: equal expressions are equal and hash alike."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass


class Node:
    """Base of all nodes; operators build calls, so trees can be written in Python too."""

    __slots__ = ()

    def children(self) -> tuple[Node, ...]:
        return ()

    def walk(self) -> Iterator[Node]:
        for child in self.children():
            yield from child.walk()
        yield self


@dataclass(frozen=True, slots=True)
class Field(Node):
    """A column of the panel, $name."""

    name: str

    def __str__(self) -> str:
        return f"${self.name}"


@dataclass(frozen=True, slots=True)
class PeriodField(Node):
    """A point-in-time column, $$name."""

    name: str

    def __str__(self) -> str:
        return f"$${self.name}"


@dataclass(frozen=True, slots=True)
class Literal(Node):
    """A number, text or truth value."""

    value: float | int | str | bool

    def __str__(self) -> str:
        return repr(self.value)


@dataclass(frozen=True, slots=True)
class Call(Node):
    """An operator with its arguments; binary symbols are calls too."""

    name: str
    args: tuple[Node, ...]

    def children(self) -> tuple[Node, ...]:
        return self.args

    def __str__(self) -> str:
        return f"{self.name}({','.join(map(str, self.args))})"


def node(value: object) -> Node:
    """A node from a node or a plain value."""
    return value if isinstance(value, Node) else Literal(value)  # type: ignore[arg-type]


def _binary(name: str, swapped: bool = False):
    def method(self: Node, other: object) -> Call:
        pair = (node(other), self) if swapped else (self, node(other))
        return Call(name, pair)

    return method


for _symbol, _name in {"add": "Add", "sub": "Sub", "mul": "Mul", "truediv": "Div", "pow": "Power", "and": "And", "or": "Or"}.items():
    setattr(Node, f"__{_symbol}__", _binary(_name))
    setattr(Node, f"__r{_symbol}__", _binary(_name, swapped=True))
for _symbol, _name in {"gt": "Gt", "ge": "Ge", "lt": "Lt", "le": "Le"}.items():
    setattr(Node, f"__{_symbol}__", _binary(_name))
