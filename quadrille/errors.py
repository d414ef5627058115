"""The engine's errors."""

from __future__ import annotations


class QuadrilleError(Exception):
    """Any error of the engine; code says which kind."""

    code = "internal"


class ParseError(QuadrilleError):
    code = "parse"

    def __init__(self, message: str, line: int | None = None, column: int | None = None) -> None:
        super().__init__(message if line is None else f"{message} (line {line}, column {column})")
        self.line, self.column = line, column


class QueryError(QuadrilleError):
    code = "query"


class GraphError(QuadrilleError):
    code = "graph"


class UnsupportedError(QuadrilleError):
    code = "unsupported"


class ShapeError(QuadrilleError):
    code = "shape"
