"""Column expressions on slash-separated paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT = "/user"


def joined(path: Column, name: Column) -> Column:
    """A child's path."""
    return F.concat(F.regexp_replace(path, "/$", ""), F.lit("/"), name)


def parts(path: Column) -> Column:
    """What lies between the first and the last slash, split."""
    return F.split(F.substr(path, F.lit(2), F.length(path) - 2), "/")


def from_parts(names: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(names, "/"), F.lit("/"))


def closed(path: Column) -> Column:
    """The path with one slash at its end."""
    return F.when(path.endswith("/"), path).otherwise(F.concat(path, F.lit("/")))


def in_range(path: Column, prefix: str, strict: bool = False) -> Column:
    """Whether a path lies in a prefix's range: what begins with the prefix, its last slash being any character up to a tilde.

    So /test/ has /test/1 and /testing but not /test itself; strict leaves only
    what begins with the whole prefix.
    """
    if not prefix.endswith("/"):
        raise ValueError("a prefix ends with a slash")
    if strict:
        return path.startswith(prefix)
    return path.between(prefix[:-1] + "\x01", prefix[:-1] + "~")
