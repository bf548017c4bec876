"""Column masks as plain expressions, chosen by the column's type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WHOLE_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_TEXT = (T.StringType, T.VarcharType, T.CharType)


def _null(data_type: T.DataType) -> Column:
    return F.lit(None).cast(data_type)


def _ones(digits: Column) -> Column:
    return F.translate(digits, "0123456789", "1" * 10)


def redact(c: Column, data_type: T.DataType) -> Column:
    """Letters become X or x, digits n; in whole numbers each digit becomes 1."""
    if isinstance(data_type, _TEXT):
        return F.mask(c)
    if isinstance(data_type, _WHOLE_NUMBERS):
        return _ones(c.cast("string")).cast(data_type)
    return _null(data_type)


def show_last_4(c: Column, data_type: T.DataType) -> Column:
    """Redact all but the last four characters or digits."""
    if not isinstance(data_type, _TEXT + _WHOLE_NUMBERS):
        return _null(data_type)
    text = c.cast("string")
    head = F.left(text, F.greatest(F.length(text) - 4, F.lit(0)))
    tail = F.right(text, F.lit(4))
    if isinstance(data_type, _TEXT):
        x = F.lit("x")
        return F.concat(F.mask(head, x, x, x, F.lit(None).cast("string")), tail)
    return F.concat(_ones(head), tail).cast(data_type)


def hashed(c: Column, data_type: T.DataType) -> Column:
    """SHA-256 in hex for text, null for other types."""
    return F.sha2(c, 256) if isinstance(data_type, _TEXT) else _null(data_type)


def nulled(c: Column, data_type: T.DataType) -> Column:
    """A null that keeps the column's type."""
    return _null(data_type)


MASKS = {
    "MASK": redact,
    "MASK_SHOW_LAST_4": show_last_4,
    "MASK_HASH": hashed,
    "MASK_NULL": nulled,
}


def mask(c: Column, data_type: T.DataType, option: str) -> Column:
    try:
        build = MASKS[option]
    except KeyError:
        raise ValueError(f"no mask named {option!r}; known: {', '.join(MASKS)}") from None
    return build(c, data_type)


def mask_sql(c: str, data_type: T.DataType, option: str) -> str:
    """The same as SQL text, for views. `c` is a quoted column name."""
    if option not in MASKS:
        raise ValueError(f"no mask named {option!r}; known: {', '.join(MASKS)}")
    kind, text = data_type.simpleString(), f"CAST({c} AS STRING)"
    ones, head = f"translate({{}}, '0123456789', '{'1' * 10}')", f"left({text}, greatest(length({text}) - 4, 0))"
    is_text, is_whole = isinstance(data_type, _TEXT), isinstance(data_type, _WHOLE_NUMBERS)
    if option == "MASK" and is_text:
        return f"mask({c})"
    if option == "MASK" and is_whole:
        return f"CAST({ones.format(text)} AS {kind})"
    if option == "MASK_SHOW_LAST_4" and is_text:
        return f"concat(mask({head}, 'x', 'x', 'x', NULL), right({text}, 4))"
    if option == "MASK_SHOW_LAST_4" and is_whole:
        return f"CAST(concat({ones.format(head)}, right({text}, 4)) AS {kind})"
    if option == "MASK_HASH" and is_text:
        return f"sha2({c}, 256)"
    return f"CAST(NULL AS {kind})"
