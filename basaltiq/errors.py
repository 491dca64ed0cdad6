"""Errors of the engine, by kind."""


class EngineError(Exception):
    """Any error of the engine."""


class ParseError(EngineError):
    pass


class TableExists(EngineError):
    pass


class TableNotFound(EngineError):
    pass


class ColumnNotFound(EngineError):
    pass


class TypeMismatch(EngineError):
    pass


class ConstraintViolation(EngineError):
    pass


class ExecutionError(EngineError):
    pass


class Unsupported(EngineError):
    pass


class Conflict(ExecutionError):
    """A table that a transaction rewrote was changed by another since it began."""
