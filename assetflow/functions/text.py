"""Column expressions on file contents: bytes to text, text to JSON."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# JSON text can only start with one of these, after JSON white space.
_JSON_START = r'^[ \t\r\n]*[{\["\-0-9tfnNI]'


@F.pandas_udf(T.StringType())
def _decode_dropping(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))


def _unix_lines(text: Column) -> Column:
    """Line ends as ``\\n``; texts without a carriage return are passed on untouched."""
    cr, lf = F.lit("\r"), F.lit("\n")
    converted = F.replace(F.replace(text, F.lit("\r\n"), lf), cr, lf)
    return F.when(F.contains(text, cr), converted).otherwise(text)


def decode_text(content: Column) -> Column:
    """Bytes of a whole file as text: invalid UTF-8 dropped, line ends as ``\\n``.

    Valid content stays in the JVM; only invalid content is sent to Python.
    """
    text = content.cast("string")
    valid = F.is_valid_utf8(text)
    repaired = _decode_dropping(F.when(~valid, content))
    return _unix_lines(F.when(valid, text).otherwise(repaired))


def _finite(number: str) -> float | None:
    value = float(number)
    return value if math.isfinite(value) else None


def _load(text: str):
    """The document; numbers that no double holds become null, as NaN and Infinity do."""
    return json.loads(text, parse_constant=lambda _: None, parse_float=_finite)


def _canonical(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        return json.dumps(_load(text))
    except (ValueError, RecursionError):
        return None


def _loads(text: str | None) -> bool:
    if text is None:
        return False
    try:
        _load(text)
        return True
    except (ValueError, RecursionError):
        return False


@F.pandas_udf(T.StringType())
def _canonical_json(text: pd.Series) -> pd.Series:
    return text.map(_canonical)


@F.pandas_udf(T.BooleanType())
def _parses(text: pd.Series) -> pd.Series:
    return text.map(_loads)


def _maybe_json(text: Column) -> Column:
    """Null for texts that cannot be JSON by their first character; Python need not see those."""
    return F.when(text.rlike(_JSON_START), text)


def canonical_json(text: Column) -> Column:
    """JSON re-written in one form, or null when ``text`` is not one JSON document.

    Spark's own parsers accept trailing text and refuse repeated keys; here the last value of
    a repeated key wins, and NaN and Infinity become null.
    """
    return _canonical_json(_maybe_json(text))


def is_json(text: Column) -> Column:
    """True when ``text`` is one JSON document by the same rules."""
    return _parses(_maybe_json(text))


def json_variant(canonical: Column) -> Column:
    """Canonical JSON as a VARIANT, whatever its shape."""
    return F.try_parse_json(canonical)
