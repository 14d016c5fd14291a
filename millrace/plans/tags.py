"""Tags of jobs: checked key and value pairs that Spark shows with the jobs of a load."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

KEYS = ("branch_id", "run_id")
# Lower-case letters of any script, digits, underscores and dashes.
_ALLOWED = re.compile(r"[\w-]*")


def check_tag(key: str, value: str) -> None:
    if key not in KEYS:
        raise ValueError(f"unknown tag {key!r}; known are {', '.join(KEYS)}")
    if len(value.encode("utf-8")) > 63 or not _ALLOWED.fullmatch(value) or value != value.lower() or any(c.isdigit() and not c.isascii() for c in value):
        raise ValueError(f"invalid value {value!r} of tag {key!r}")


@contextmanager
def tagged(spark: SparkSession, **tags: str) -> Iterator[None]:
    """Tag all jobs within."""
    for key, value in tags.items():
        check_tag(key, value)
    names = [f"{k}={v}" for k, v in tags.items()]
    for name in names:
        spark.addTag(name)
    try:
        yield
    finally:
        for name in names:
            spark.removeTag(name)
