"""Path expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(path: str | Column) -> Column:
    return F.col(path) if isinstance(path, str) else path


def basename(path: str | Column) -> Column:
    return F.regexp_extract(_col(path), "([^/]*)$", 1)


def stem(path: str | Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: str | Column) -> Column:
    """The last extension in lower case with its dot, or empty."""
    return F.lower(F.regexp_extract(_col(path), r"(\.[^./]+)$", 1))


def parent(path: str | Column, up: int = 1) -> Column:
    """Name of the directory ``up`` levels above the file."""
    return F.coalesce(F.get(F.reverse(F.split(_col(path), "/")), F.lit(up)), F.lit(""))


def remap(path: str | Column, prefix: str, root: str) -> Column:
    """Backslashes to slashes, ``prefix`` (any case) off, ``root`` in front."""
    plain = F.regexp_replace(F.replace(_col(path), F.lit("\\"), F.lit("/")), "(?i)^" + re.escape(prefix).replace("/", "/"), "")
    return F.concat_ws("/", F.lit(root.rstrip("/")), F.ltrim(plain, F.lit("/")))
