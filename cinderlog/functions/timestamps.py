"""Timestamps of many notations to seconds since 1970, as column expressions.

The order of attempts is: the caller's format; a number (seconds, or a finer unit, folded down until it is plausible);
ISO 8601; the common notations below. Nothing matches: 0. Times without a zone are UTC. Unlike a parser with a memory, the
same text always gives the same time.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinderlog.functions.text import groups, squeeze

#: Seconds from 1900 to 1970: a time of day without a date is on the first day of 1900.
SINCE_1900 = 2_208_988_800
#: strftime's letters as Spark's date patterns, and English names of days, which those don't read.
LETTERS = {"Y": "yyyy", "m": "M", "d": "d", "H": "H", "M": "m", "S": "s", "b": "MMM", "B": "MMMM", "y": "yy", "I": "h", "p": "a", "j": "D"}
DAYS = r"(?i)\b(mon|tues?|wed(nes)?|thu(rs?)?|fri|sat(ur)?|sun)(day)?\b,?\s*"
ZONE = r"([+-]\d{2}):?(\d{2})$"


def _at(text: Column, pattern: str) -> Column:
    return F.unix_timestamp(F.try_to_timestamp(text, F.lit(pattern)))


def with_format(text: Column, fmt: str, year: Column | None = None) -> Column:
    """Seconds by a strftime format, or null. Formats without a year take `year` if they have a day, else 1900."""
    pattern, i, zone, fraction = "", 0, False, False
    while i < len(fmt):
        c = fmt[i]
        if c == "%" and i + 1 < len(fmt):
            i += 1
            d = fmt[i]
            if d == "f":
                fraction = True
                if pattern and pattern[-1] in ".,":
                    pattern = pattern[:-1]
            elif d == "z":
                zone = True
                pattern = pattern.rstrip()
            elif d in "Aa":
                pass
            elif d == "%":
                pattern += "%"
            elif d in LETTERS:
                pattern += LETTERS[d]
            elif d == "T":
                pattern += "H:m:s"
            else:
                raise ValueError(f"%{d} in a time format")
        elif c.isalpha() or c == "'":
            pattern += "''" if c == "'" else f"'{c}'"
        else:
            pattern += c
        i += 1
    named = "%A" in fmt or "%a" in fmt
    clean = squeeze(text)
    if named:
        clean, pattern = F.regexp_replace(clean, DAYS, ""), pattern.lstrip(", ")
    offset = F.lit(0)
    ok = F.lit(True)
    if zone:
        # A trailing Z, or hours and minutes.
        part = F.regexp_extract(clean, r"(Z|[+-]\d{2}:?\d{2})$", 1)
        hours = F.regexp_extract(part, ZONE, 1).try_cast("int")
        minutes = F.regexp_extract(part, ZONE, 2).try_cast("int")
        seconds = F.when(part.startswith("-"), hours * 3600 - minutes * 60).otherwise(hours * 3600 + minutes * 60)
        offset, ok = F.coalesce(seconds, F.lit(0)), part != ""
        clean = F.regexp_replace(clean, r"\s*(Z|[+-]\d{2}:?\d{2})$", "")
    if fraction:
        ok = ok & clean.rlike(r"[.,]\d{1,6}('?Z'?)?$")
        clean = F.regexp_replace(clean, r"[.,]\d{1,6}(?=Z?$)", "")
    if "%Y" not in fmt and "%y" not in fmt:
        if "%d" in fmt or "%j" in fmt:
            clean, pattern = F.concat(F.coalesce(year, F.year(F.current_date())).cast("string") if year is not None else F.year(F.current_date()).cast("string"), F.lit(" "), clean), f"yyyy {pattern}"
        else:
            return F.when(ok, _at(clean, pattern) - SINCE_1900 - offset)
    return F.when(ok, _at(clean, pattern) - offset)


def number(text: Column) -> Column:
    """Seconds from a plain number of seconds, or of thousandths and so on, or null: three digits go as often as it takes to
    come down to 100,000,000,000."""
    digits = F.ltrim(F.regexp_extract(text, r"^(\d+)", 1), F.lit("0"))
    size = F.length(digits)
    folds = F.greatest(F.lit(0), F.ceil((size - 11) / 3))
    left = lambda k: F.substring(digits, F.lit(1), (size - 3 * k).cast("int"))
    # One fold less is enough for the very number that it has to come down to.
    whole = F.when(left(folds - 1) == "100000000000", left(folds - 1)).otherwise(left(folds))
    plain = text.rlike(r"^\d+(\.\d+)?$") & (size <= 38)
    return F.when(plain, F.coalesce(F.when(size <= 11, digits).otherwise(whole).try_cast("long"), F.lit(0)))


#: Date, time, fraction and zone, each finer part only after the one before it.
_ISO = r"^(\d{4})-?(\d{2})-?(\d{2})(?:[T ](\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,]\d{1,9})?)?)?(?:([+-])(\d{2})(?::?(\d{2})(?::?\d{2})?)?)?)?$"


def iso(text: Column) -> Column:
    """ISO 8601, with or without a time, a fraction and a zone."""

    def seconds(parts: Column) -> Column:
        # Null instead of '': a cast that fails, even a tried one, costs an exception a row.
        part = lambda i: F.coalesce(F.nullif(F.get(parts, F.lit(i)), F.lit("")).cast("int"), F.lit(0))
        day = F.unix_date(F.concat_ws("-", *(F.get(parts, F.lit(i)) for i in range(3))).try_cast("date")).cast("long") * 86_400
        offset = F.when(F.get(parts, F.lit(6)) == "-", -1).otherwise(1) * (part(7) * 3600 + part(8) * 60)
        valid = (part(3) < 24) & (part(4) < 60) & (part(5) < 60)
        return F.when(valid, day + part(3) * 3600 + part(4) * 60 + part(5) - offset)

    clean = F.regexp_replace(text, "Z$", "+00:00")
    # The parts are cut out once, and bound to a name.
    found = F.get(F.transform(F.array(groups(clean, _ISO, 9)), seconds), F.lit(0))
    return F.when(clean.rlike(_ISO), found)


#: Notations tried last, in this order.
COMMON = (
    "%Y/%m/%d %H:%M:%S",
    "%d/%b/%Y:%H:%M:%S %z",
    "%d/%b/%Y:%H:%M:%S",
    "%b %d %H:%M:%S",
    "%H:%M:%S",
    "%A, %B %d, %Y %H:%M:%S",
)


def to_seconds(text: Column, fmt: str | None = None, year: Column | None = None) -> Column:
    """Long: seconds since 1970, 0 if the text is null, empty or of no known notation. year: for notations without one, by
    default the current year."""
    tries = ([with_format(text, fmt, year)] if fmt else []) + [number(text), iso(text), *(with_format(text, f, year) for f in COMMON)]
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0)).otherwise(F.coalesce(*tries, F.lit(0))).cast("long")
