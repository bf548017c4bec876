"""Values of workbook cells and texts of paragraphs and shapes, from what tasks cut."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parchmill.formats.cut import CELL, FIELD
from parchmill.functions.text import truthy

# Built-in number formats that show dates, times or a duration.
_BUILTIN_DATES = tuple(f"#{n}" for n in (14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47))
_BUILTIN_DURATION = "#46"
_DAY_MS = 86_400_000
# Days that can be dates, from the year 1 to 9999, counted from 1899-12-30.
_FIRST_DAY, _LAST_DAY = -693_593, 2_958_465


def unescaped(markup: Column) -> Column:
    """Text of markup that has no tags left."""
    out = markup
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return out


def _tokens(markup: Column, signs: dict[str, str]) -> Column:
    """Texts of <t> tags and what stands for other tags, in order."""
    found = F.regexp_extract_all(markup, F.lit(r"<t>[^<]*</t>|<[a-z]+/>"), F.lit(0))

    def piece(token: Column) -> Column:
        out = unescaped(F.substring(token, F.lit(4), F.length(token) - 7))
        for tag, sign in signs.items():
            out = F.when(token == f"<{tag}/>", sign).otherwise(out)
        return out

    return F.array_join(F.transform(found, piece), "")


def paragraph_text(markup: Column) -> Column:
    return _tokens(markup, {"tab": "\t", "hyphen": "-", "br": "\n"})


def shape_text(markup: Column) -> Column:
    """Paragraphs with a line feed between them, breaks in them as vertical tabs."""
    return _tokens(markup, {"p": "\n", "br": "\v"})


def _is_duration(shown: Column) -> Column:
    return (shown == _BUILTIN_DURATION) | F.substring_index(shown, ";", 1).rlike(r"(?i)\[(h+|m+|s+)\]")


def _is_date(shown: Column) -> Column:
    code = F.regexp_replace(F.substring_index(shown, ";", 1), r'\[[^\]]*\]|"[^"]*"|[\\_*].', "")
    own = ~shown.startswith("#") | shown.rlike(r"\A#.*[^0-9]")
    return shown.isin(*_BUILTIN_DATES) | (own & code.rlike("(?i)[dmhys]")) | _is_duration(shown)


def _fraction(ms: Column) -> Column:
    """Milliseconds after the seconds, as Python spells them."""
    part = F.concat(F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"), F.lit("000"))
    return F.when(ms % 1000 == 0, "").otherwise(part)


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def _clock(ms: Column, hours: Column) -> Column:
    minutes, seconds = F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60
    return F.concat(hours, F.lit(":"), _two(minutes), F.lit(":"), _two(seconds), _fraction(ms))


def _serial(number: Column, mac: Column) -> tuple[Column, Column]:
    """(days from 1899-12-30, milliseconds of the day) of a date's number."""
    days = F.floor(number)
    ms = F.bround((number - days) * _DAY_MS).cast("long")
    days = days + F.floor(ms / _DAY_MS)
    # The calendar of this format has a 29 February 1900; another one begins in 1904.
    days = days + F.when(mac, 1462).when((number > 0) & (number < 60), 1).otherwise(0)
    return days, F.pmod(ms, F.lit(_DAY_MS))


def _after_sign(field: Column, empty: bool) -> Column:
    """What a field holds; null if it has no sign, or nothing after it and not `empty`."""
    return F.when(F.length(field) > (0 if empty else 1), F.substring(field, F.lit(2), F.length(field)))


def _stored(f: Column) -> Column:
    return F.struct(
        f[0].cast("int").alias("cell_no"),
        f[1].alias("type"),
        _after_sign(f[2], True).alias("shown"),
        _after_sign(f[3], False).alias("value"),
        _after_sign(f[4], True).alias("formula"),
        _after_sign(f[5], True).alias("inline"),
    )


def _dated(c: Column, mac: Column) -> Column:
    """The cell, and of a date its day (from 1899-12-30), milliseconds of the day and kind
    of date; all null in other cells."""
    number = c["value"].cast("double")
    days, ms = _serial(number, mac)
    is_time = (number >= 0) & (F.floor(F.bround(number * _DAY_MS) / _DAY_MS) == 0)
    kind = (
        F.when(_is_duration(c["shown"]), "duration")
        .when(is_time, "time")
        .when(~days.between(_FIRST_DAY, _LAST_DAY), "outside")
        .otherwise("date")
    )
    is_date = (c["type"] == "n") & c["shown"].isNotNull() & _is_date(c["shown"])
    moment = F.struct(days.alias("days"), ms.alias("ms"), kind.alias("kind"), F.bround(number * _DAY_MS).cast("long").alias("total"))
    return F.struct(c.alias("c"), F.when(is_date, moment).alias("date"))


def _value(both: Column, formulas: bool) -> Column:
    """cell_no, text, kind and keep of a cell."""
    c, date = both["c"], both["date"]
    value, kind = c["value"], c["type"]
    is_formula = c["formula"].isNotNull() if formulas else F.lit(False)
    ms, total = date["ms"], date["total"]
    clock = _clock(ms, _two(F.floor(ms / 3_600_000)))
    day = F.date_add(F.lit("1899-12-30").cast("date"), date["days"].cast("int"))
    whole = F.floor(total / _DAY_MS)
    rest = total - whole * _DAY_MS
    plural = F.when(F.abs(whole) == 1, " day, ").otherwise(" days, ")
    lead = F.when(whole == 0, "").otherwise(F.concat(whole.cast("string"), plural))
    iso = F.regexp_replace(F.replace(value, F.lit("T"), F.lit(" ")), "Z$", "")
    dated = (
        F.when(date["kind"] == "duration", F.concat(lead, _clock(rest, F.floor(rest / 3_600_000).cast("string"))))
        .when(date["kind"] == "time", clock)
        .when(date["kind"] == "outside", "#VALUE!")
        .otherwise(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" "), clock))
    )
    text = (
        F.when(is_formula, F.concat(F.lit("="), c["formula"]))
        .when(kind.isin("inlineStr", "s"), c["inline"])
        .when(kind == "b", F.when(value == "0", "False").otherwise("True"))
        .when(kind == "d", iso)
        .when(date.isNotNull(), dated)
        .otherwise(value)
    )
    named = (
        F.when(is_formula | kind.isin("inlineStr", "s", "str"), "string")
        .when(kind == "b", "boolean")
        .when(kind == "e", "error")
        .when(kind == "d", F.when(iso.rlike(r"\A\d+-\d+-\d+"), "timestamp_ntz").otherwise("string"))
        .when(date["kind"].isin("duration", "time"), "string")
        .when(date["kind"] == "outside", "error")
        .when(date["kind"] == "date", "timestamp_ntz")
        .when(value.rlike(r"\A-?\d+\z") & value.try_cast("bigint").isNotNull(), "bigint")
        .otherwise("double")
    )
    keep = (
        F.when(kind == "b", value != "0")
        .when(is_formula, True)
        .when(date["kind"] == "duration", total != 0)
        .when((kind == "n") & date.isNull(), value.cast("double") != 0)
        .when(kind.isin("inlineStr", "s"), truthy(c["inline"], "string"))
        .when(kind == "d", truthy(iso, "string"))
        .otherwise(value != "")
    )
    return F.struct(
        c["cell_no"].alias("cell_no"),
        F.coalesce(text, F.lit("")).alias("text"),
        named.alias("kind"),
        F.coalesce(keep, F.lit(False)).alias("keep"),
    )


def row_cells(content: Column, what: Column, formulas: bool) -> Column:
    """The cells with a value of a row's piece, in order: an array of cell_no, text, kind
    and keep.

    `text` is the value as Python spells it. `kind` is bigint, double, boolean,
    timestamp_ntz, string, or error. `keep` is whether the value is a true one.
    `formulas` gives cells with a formula as that formula, as stored: cells that share
    another's have none of their own. Otherwise it is the result stored with it.
    """
    fields = F.transform(F.split(content, CELL), lambda c: F.split(c, FIELD))
    cells = F.transform(F.filter(fields, lambda f: F.size(f) == 6), _stored)

    def present(c: Column) -> Column:
        held = F.when(c["type"] == "inlineStr", c["inline"].isNotNull()).otherwise(c["value"].isNotNull())
        return held | c["formula"].isNotNull() if formulas else held

    mac = what.startswith("row1904")
    dated = F.transform(F.filter(cells, present), lambda c: _dated(c, mac))
    return F.transform(dated, lambda both: _value(both, formulas))
