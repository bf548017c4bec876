"""Text expressions: strip, split, file names. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that Unicode counts as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# A name without its last extension; leading dots do not start an extension.
_STEM = r"(?s)^(\.*[^.].*)\.[^.]*\z"


def strip(c: Column) -> Column:
    """Remove white space of any script from both ends (linear, no regex)."""
    return F.btrim(c, F.lit(WHITESPACE))


def split_fields(c: Column, delimiter: str) -> Column:
    """Split on a literal delimiter and keep empty fields at the end."""
    return F.split(c, r"\Q" + delimiter + r"\E", -1)


def count_char(c: Column, char: str) -> Column:
    """How often one character occurs."""
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), _STEM, "$1")


def out_name(path: Column) -> Column:
    """Name of the text file that a document becomes."""
    return F.concat(stem(path), F.lit(".txt"))


def truthy(value: Column, data_type: str) -> Column:
    """False for null, empty text, zero and false."""
    if data_type == "string":
        test = value != F.lit("")
    elif data_type == "boolean":
        test = value
    else:
        test = value != F.lit(0)
    return F.coalesce(test, F.lit(False))
