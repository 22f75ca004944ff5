"""Typed failures.  A failed query is never mistaken for a complete answer."""

from __future__ import annotations

from typing import NamedTuple


class Span(NamedTuple):
    """Half-open range of UTF-8 bytes in the query text."""

    start: int
    end: int


class PipeError(Exception):
    """Base of all failures of this engine."""


class SpannedError(PipeError):
    """A failure at a place in the query text."""

    def __init__(self, message: str, span: Span):
        super().__init__(f"{message} at bytes {span[0]}..{span[1]}")
        self.message, self.span = message, Span(*span)


class ParseError(SpannedError):
    """The text doesn't match the grammar."""


class BindError(SpannedError):
    """The syntax doesn't fit its inputs' names or types."""


class DivisionByZero(SpannedError):
    def __init__(self, span: Span):
        super().__init__("division by zero", span)


class ArithmeticOverflow(SpannedError):
    def __init__(self, operation: str, span: Span):
        super().__init__(f"{operation} overflows", span)
        self.operation = operation


class ArithmeticDomain(SpannedError):
    def __init__(self, operation: str, span: Span):
        super().__init__(f"{operation} is undefined for its argument", span)
        self.operation = operation


class InputError(PipeError):
    """Invalid input data; ``byte_offset`` counts from zero."""

    def __init__(self, message: str, byte_offset: int = 0):
        super().__init__(f"{message} at byte {byte_offset}")
        self.message, self.byte_offset = message, byte_offset


class ResourceError(PipeError):
    """A limit would be exceeded."""

    def __init__(self, owner: str, required: int, limit: int):
        super().__init__(f"{owner}: {required} needed, limit {limit}")
        self.owner, self.required, self.limit = owner, required, limit


class AlreadyExists(PipeError):
    pass


class NotFound(PipeError):
    pass


class InvalidName(PipeError):
    pass


class Cancelled(PipeError):
    pass


class Contention(PipeError):
    """Another writer or cleanup is at work; try again later."""


class Unsupported(PipeError):
    pass
