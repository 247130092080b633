"""Column functions for text and numbers whose results match those of Python's own string and float functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that Java's patterns give a meaning to; and a number as Python's float() takes it.
MEANS = set("\\.[]{}()*+-?^$|<>#&~")
NUMBER = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*$"


def literal(text: str) -> str:
    """A Java pattern that matches just this text."""
    return "".join("\\" + c if c in MEANS else c for c in text)


#: A character that stands between groups while they are cut out of a text.
_CUT = "\x01"


def groups(text: Column, pattern: str, n: int) -> Column:
    """array<string> of the n groups of a pattern that matches the whole text, by matching it once. Texts that hold the character
    used to cut take one match a group."""
    if n == 0:
        return F.array().cast("array<string>")
    once = F.split(F.regexp_replace(text, pattern, _CUT.join(f"${g}" for g in range(1, n + 1))), _CUT, -1)
    each = F.array(*(F.regexp_extract(text, pattern, g) for g in range(1, n + 1)))
    return F.when(F.contains(text, F.lit(_CUT)), each).otherwise(once)


def squeeze(text: Column) -> Column:
    """Trimmed, with each run of white space as one space."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def as_number(text: Column) -> Column:
    """Double, or null where float() refuses the text."""
    return F.when(text.rlike(NUMBER), strip(text).try_cast("double"))


def number_text(x: Column) -> Column:
    """A number as it prints: whole ones without a fraction."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("long").cast("string")).otherwise(x.cast("string"))


def quoted_list(values: Column) -> Column:
    """'a', 'b'."""
    return F.array_join(F.transform(values, lambda c: F.concat(F.lit("'"), c, F.lit("'"))), ", ")


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def bigrams(text: Column) -> Column:
    """array<struct<a, b>> of each two characters in a row; '' stands for the text's start and end."""
    padded = lambda c: F.concat(F.array(F.lit("")), c, F.array(F.lit("")))
    pair = lambda p: F.transform(F.sequence(F.lit(0), F.size(p) - 2), lambda i: F.struct(F.get(p, i).alias("a"), F.get(p, i + 1).alias("b")))
    return F.flatten(F.transform(F.array(padded(characters(text))), pair))


def ruzicka(a: Column, b: Column) -> Column:
    """Distance of two vectors of counts: the sum of differences over the sum of greater parts; shorter ones end in 0."""
    zip_ = lambda f: F.aggregate(F.zip_with(a, b, lambda x, y: f(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))).cast("double")), F.lit(0.0), lambda s, x: s + x)
    most = zip_(F.greatest)
    return F.when(most == 0, F.lit(0.0)).otherwise(zip_(lambda x, y: F.abs(x - y)) / most)
