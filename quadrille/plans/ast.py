"""The query language's syntax tree. Terms are quadrille.terms.Term, variables Var."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from ..terms import Term


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Quoted:
    """A quoted triple pattern as a node."""

    s: Any
    p: Any
    o: Any


Node = Any  # Var, Term or Quoted


# property paths
@dataclass(frozen=True)
class Path:
    pass


@dataclass(frozen=True)
class Link(Path):
    iri: str


@dataclass(frozen=True)
class Inverse(Path):
    path: Path


@dataclass(frozen=True)
class Sequence(Path):
    steps: tuple[Path, ...]


@dataclass(frozen=True)
class Alternative(Path):
    options: tuple[Path, ...]


@dataclass(frozen=True)
class Repeat(Path):
    """From low to high times; high None is without end."""

    path: Path
    low: int
    high: int | None


@dataclass(frozen=True)
class Negated(Path):
    forward: tuple[str, ...] = ()
    backward: tuple[str, ...] = ()


# expressions
@dataclass(frozen=True)
class Const:
    term: Term


@dataclass(frozen=True)
class Ref:
    var: str


@dataclass(frozen=True)
class Call:
    """A function or an operator; name in lower case."""

    name: str
    args: tuple[Any, ...] = ()


@dataclass(frozen=True)
class Aggregate:
    name: str
    arg: Any = None  # None is *
    distinct: bool = False
    separator: str = " "


@dataclass(frozen=True)
class Exists:
    group: "Group"
    negated: bool = False


# patterns
@dataclass(frozen=True)
class Triple:
    s: Node
    p: Node | Path
    o: Node


@dataclass(frozen=True)
class Group:
    parts: tuple[Any, ...] = ()


@dataclass(frozen=True)
class Optional_:
    group: Group


@dataclass(frozen=True)
class Union_:
    branches: tuple[Group, ...]


@dataclass(frozen=True)
class Minus:
    group: Group


@dataclass(frozen=True)
class Filter:
    expr: Any


@dataclass(frozen=True)
class Bind:
    expr: Any
    var: str


@dataclass(frozen=True)
class Graph:
    name: Node
    group: Group


@dataclass(frozen=True)
class Service:
    name: Node
    group: Group
    silent: bool = False


@dataclass(frozen=True)
class Values:
    vars: tuple[str, ...]
    rows: tuple[tuple[Term | None, ...], ...]


@dataclass(frozen=True)
class Reifier:
    """reifier rdf:reifies a quoted triple."""

    reifier: Node
    triple: Quoted


@dataclass(frozen=True)
class SubSelect:
    query: "Select"


@dataclass(frozen=True)
class Select:
    items: tuple[tuple[str, Any], ...] | None  # (name, expression); None is *
    where: Group
    froms: tuple[str, ...] = ()
    from_named: tuple[str, ...] = ()
    group_by: tuple[tuple[str, Any], ...] = ()
    having: tuple[Any, ...] = ()
    order_by: tuple[tuple[Any, bool], ...] = ()  # (expression, descending)
    limit: int | None = None
    offset: int | None = None
    distinct: bool = False
    reduced: bool = False


@dataclass(frozen=True)
class Ask:
    where: Group
    froms: tuple[str, ...] = ()
    from_named: tuple[str, ...] = ()


@dataclass(frozen=True)
class Construct:
    template: tuple[Triple, ...]
    where: Group
    froms: tuple[str, ...] = ()
    from_named: tuple[str, ...] = ()
    order_by: tuple[tuple[Any, bool], ...] = ()
    limit: int | None = None
    offset: int | None = None


@dataclass(frozen=True)
class Describe:
    terms: tuple[Node, ...] | None  # None is *
    where: Group
    froms: tuple[str, ...] = ()
    from_named: tuple[str, ...] = ()


# updates; a quad pattern is (graph or None, Triple)
@dataclass(frozen=True)
class InsertData:
    quads: tuple[tuple[Node | None, Triple], ...]


@dataclass(frozen=True)
class DeleteData:
    quads: tuple[tuple[Node | None, Triple], ...]


@dataclass(frozen=True)
class Modify:
    delete: tuple[tuple[Node | None, Triple], ...]
    insert: tuple[tuple[Node | None, Triple], ...]
    where: Group
    with_: str | None = None
    using: tuple[str, ...] = ()
    using_named: tuple[str, ...] = ()


@dataclass(frozen=True)
class Load:
    source: str
    into: str | None = None
    silent: bool = False


@dataclass(frozen=True)
class GraphOp:
    """clear, drop, create, copy, move or add; graphs are IRIs or DEFAULT, NAMED, ALL."""

    op: str
    source: str
    target: str | None = None
    silent: bool = False


@dataclass(frozen=True)
class Update:
    ops: tuple[Any, ...] = field(default=())
