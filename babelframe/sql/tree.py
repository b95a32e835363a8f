"""The syntax tree. Nodes are frozen and compare by structure, which aggregate and group-key lookup rely on."""

from __future__ import annotations

from dataclasses import dataclass, fields, is_dataclass, replace
from typing import Any


@dataclass(frozen=True)
class Name:
    text: str
    quoted: bool = False


class Node:
    pass


@dataclass(frozen=True)
class Lit(Node):
    value: Any
    kind: str  # INT, FLOAT, TEXT, BOOL, DATE, TIMESTAMP, NULL


@dataclass(frozen=True)
class Col(Node):
    name: Name
    table: Name | None = None


@dataclass(frozen=True)
class Star(Node):
    table: Name | None = None


@dataclass(frozen=True)
class Unary(Node):
    op: str  # neg, pos, not
    arg: Node


@dataclass(frozen=True)
class Binary(Node):
    op: str  # add sub mul div mod concat eq neq lt lte gt gte and or null_safe_eq null_safe_neq
    left: Node
    right: Node


@dataclass(frozen=True)
class IsNull(Node):
    arg: Node
    negated: bool = False


@dataclass(frozen=True)
class Between(Node):
    arg: Node
    low: Node
    high: Node
    negated: bool = False


@dataclass(frozen=True)
class InList(Node):
    arg: Node
    items: tuple[Node, ...]
    negated: bool = False


@dataclass(frozen=True)
class InQuery(Node):
    arg: Node
    query: Query
    negated: bool = False


@dataclass(frozen=True)
class Like(Node):
    arg: Node
    pattern: Node
    insensitive: bool = False
    negated: bool = False


@dataclass(frozen=True)
class Case(Node):
    branches: tuple[tuple[Node, Node], ...]
    otherwise: Node | None = None


@dataclass(frozen=True)
class Cast(Node):
    arg: Node
    kind: str


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...]
    star: bool = False
    distinct: bool = False
    where: Node | None = None
    over: Over | None = None
    ignore_nulls: bool = False


@dataclass(frozen=True)
class OrderKey:
    expr: Node
    descending: bool = False
    nulls: str | None = None  # first, last


@dataclass(frozen=True)
class Frame:
    unit: str  # rows, range, groups
    start: tuple[str, int | None]  # (unbounded | current | preceding | following, n)
    end: tuple[str, int | None]


@dataclass(frozen=True)
class Over:
    partition: tuple[Node, ...] = ()
    order: tuple[OrderKey, ...] = ()
    frame: Frame | None = None


@dataclass(frozen=True)
class Scalar(Node):
    query: Query


@dataclass(frozen=True)
class Exists(Node):
    query: Query
    negated: bool = False


@dataclass(frozen=True)
class Item:
    expr: Node
    alias: Name | None = None


@dataclass(frozen=True)
class Table:
    name: Name
    alias: Name | None = None


@dataclass(frozen=True)
class Derived:
    query: Query
    alias: Name | None
    lateral: bool = False


@dataclass(frozen=True)
class Join:
    kind: str  # inner left right full cross semi anti
    right: Table | Derived
    on: Node | None = None
    using: tuple[Name, ...] = ()


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    source: Table | Derived
    joins: tuple[Join, ...] = ()
    where: Node | None = None
    group: tuple[Node, ...] = ()
    having: Node | None = None
    qualify: Node | None = None
    distinct: bool = False


@dataclass(frozen=True)
class SetOp:
    kind: str  # union intersect except
    left: Select | SetOp | Query
    right: Select | SetOp | Query
    all: bool = False


@dataclass(frozen=True)
class Cte:
    name: Name
    query: Query


@dataclass(frozen=True)
class Query:
    body: Select | SetOp | Query
    order: tuple[OrderKey, ...] = ()
    limit: int | None = None
    offset: int = 0
    ties: bool = False
    ctes: tuple[Cte, ...] = ()
    recursive: bool = False


def walk(node: Any, into_queries: bool = False):
    """The node and all below it; queries inside expressions are not entered unless asked for."""
    if isinstance(node, tuple):
        for x in node:
            yield from walk(x, into_queries)
    elif is_dataclass(node):
        yield node
        if isinstance(node, Query) and not into_queries:
            return
        for f in fields(node):
            yield from walk(getattr(node, f.name), into_queries)


def rebuild(node: Any, change) -> Any:
    """The tree with change(node) applied bottom-up to every dataclass node."""
    if isinstance(node, tuple):
        return tuple(rebuild(x, change) for x in node)
    if is_dataclass(node) and not isinstance(node, type):
        new = {f.name: rebuild(getattr(node, f.name), change) for f in fields(node)}
        return change(replace(node, **new))
    return node
