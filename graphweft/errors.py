"""Failures, each with a status name."""

from __future__ import annotations


class GraphError(Exception):
    """status: INVALID_ARGUMENT, NOT_FOUND, PARSE_ERROR, EXISTS, OOM, IO_ERROR, CORRUPT or LIMIT."""

    def __init__(self, status: str, message: str, **details):
        super().__init__(f"{status}: {message}")
        self.status, self.message, self.details = status, message, details


def parse_error(message: str) -> GraphError:
    return GraphError("PARSE_ERROR", message)
