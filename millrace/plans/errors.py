"""Errors of loads, and the sorting of Spark's errors into them."""

from __future__ import annotations

from pyspark.errors import PySparkException


MOST_ROWS = 10


class LoadError(Exception):
    """A failed load; ``rows`` tells what is wrong with some of its rows, at most ``MOST_ROWS``."""

    rows: tuple[str, ...] = ()

    def with_rows(self, rows: list[str]) -> LoadError:
        self.rows = tuple(rows[:MOST_ROWS])
        more = ["there are more"] if len(rows) > MOST_ROWS else []
        self.args = ("\n".join([str(self.args[0]) if self.args else "", *self.rows, *more]), *self.args[1:])
        return self


class ColumnsMismatch(LoadError):
    def __init__(self, message: str, source: list[str], destination: list[str]):
        super().__init__(message)
        self.source, self.destination = source, destination


class FileNotFound(LoadError):
    pass


class NotNullViolation(LoadError):
    pass


class ValueConversion(LoadError):
    pass


class RowTooLarge(LoadError):
    pass


class MalformedInput(LoadError):
    pass


# Spark's error conditions, or words of a failed row check, by kind.
KINDS: list[tuple[type[LoadError], tuple[str, ...]]] = [
    (FileNotFound, ("PATH_NOT_FOUND", "FileNotFoundException")),
    (NotNullViolation, ("NOT_NULL:", "NOT_NULL_ASSERT_VIOLATION")),
    (RowTooLarge, ("EXCEED_LIMIT_LENGTH",)),
    (MalformedInput, ("MALFORMED_RECORD", "MALFORMED_CSV_RECORD", "FAILED_READ_FILE")),
    (ValueConversion, ("VALUE_CONVERSION", "CAST_INVALID_INPUT", "CAST_OVERFLOW", "CONVERSION_INVALID_INPUT", "NUMERIC_VALUE_OUT_OF_RANGE", "INVALID_VARIANT_CAST", "MALFORMED_RECORD_IN_PARSING", "CANNOT_PARSE")),
]


def classified(error: Exception) -> Exception:
    """The load error for an error of Spark, or the error itself."""
    if isinstance(error, LoadError):
        return error
    condition = error.getCondition() if isinstance(error, PySparkException) else ""
    text = f"{condition or ''} {error}"
    for kind, words in KINDS:
        if any(w in text for w in words):
            found = kind(str(error).split("\n")[0][:1000])
            found.__cause__ = error
            return found
    return error
