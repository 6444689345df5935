"""Errors. All of them are raised while a plan is built, before any job runs."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all errors of the engine."""


class SchemaError(EngineError):
    """A collection or a record breaks the rules of its schema."""


class NotFoundError(EngineError):
    """A database, collection, partition, alias, index or snapshot doesn't exist."""


class AlreadyExistsError(EngineError):
    """The name is taken."""


class StateError(EngineError):
    """The operation isn't allowed in the present state (not loaded, in use, closed)."""


class QueryError(EngineError):
    """Bad arguments of a search, query or rerank chain."""


class FilterError(EngineError):
    """A filter expression is wrong; ``position`` counts from 0."""

    def __init__(self, message: str, expression: str = "", position: int = 0):
        self.source, self.position = expression, position
        mark = f"\n  {expression}\n  {' ' * position}^" if expression else ""
        super().__init__(f"{message} (at {position}){mark}")


class FilterParseError(FilterError):
    """The text isn't an expression."""


class FilterFieldError(FilterError):
    """A field is unknown or can't be used."""


class FilterTypeError(FilterError):
    """Operand types don't fit."""
