"""Normal forms of tags and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tag_value(c: Column | str) -> Column:
    """A sequence tag, trimmed and in upper case; null, empty and ``NA`` give null."""
    value = F.upper(F.trim(F.col(c) if isinstance(c, str) else c))
    return F.when((value != "") & (value != "NA"), value)


def key_value(c: Column | str) -> Column:
    """The part of a key before the first ``|``, trimmed and in upper case; null, empty and ``NA`` give null."""
    c = F.col(c) if isinstance(c, str) else c
    value = F.upper(F.trim(F.substring_index(c, "|", 1)))
    return F.when((value != "") & (value != "NA"), value)


def plain_value(c: Column | str) -> Column:
    """A value as written; null, empty and ``NA`` in any letter case give null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when((c != "") & (F.upper(F.trim(c)) != "NA"), c)
