"""Errors that a user of the engine can act on."""


class QueryError(Exception):
    """A statement that can't be run: its text, a name in it, or a type doesn't fit."""


class UnsupportedError(QueryError):
    """Valid SQL that the engine doesn't offer."""


class LoadError(Exception):
    """A file that can't be read as a table."""
