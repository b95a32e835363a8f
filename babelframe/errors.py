"""Errors by stage of a query's life."""


class SqlError(Exception):
    """stage: parse, bind or run."""

    stage = "run"


class ParseError(SqlError):
    stage = "parse"


class BindError(SqlError):
    stage = "bind"


class RunError(SqlError):
    stage = "run"
