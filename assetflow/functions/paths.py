"""Column expressions on file paths."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from assetflow.constants import CATEGORY_BY_EXT, SUPPORTED_EXTS

def file_name(path: Column) -> Column:
    """Last path component."""
    return F.substring_index(path, "/", -1)


def _after_last_dot(name: Column) -> Column:
    """Text after the last dot; null without a dot that has something before it."""
    last = F.substring_index(name, ".", -1)
    return F.when(F.length(name) - F.length(last) > 1, last)


def suffix(name: Column) -> Column:
    """``.ext`` as written, or an empty string."""
    last = _after_last_dot(name)
    return F.when(last != "", F.concat(F.lit("."), last)).otherwise("")


def stem(name: Column) -> Column:
    """Name without its suffix."""
    return F.substr(name, F.lit(1), F.length(name) - F.length(suffix(name)))


def extension(path: Column) -> Column:
    """Lower-cased suffix without the dot; empty when there is none."""
    return F.coalesce(F.lower(_after_last_dot(file_name(path))), F.lit(""))


def supported_extension(path: Column) -> Column:
    """Extension when it is one we handle, else null."""
    ext = extension(path)
    return F.when(ext.isin(*SUPPORTED_EXTS), ext)


def category(ext: Column) -> Column:
    """Category folder of a supported extension, else null."""
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(CATEGORY_BY_EXT.items())])
    return F.element_at(pairs, ext)
