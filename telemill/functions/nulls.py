"""Emptiness, truth and numbers of text columns.

Missing is never zero.  Sources differ in what they call empty, so every test takes its own tokens; the token sets below
are those of the record formats that this engine reads.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for a missing value.
PAYLOAD_TOKENS = ("nan",)
ROW_TOKENS = ("nan", "none", "null", "<na>")
NUMBER_TOKENS = ("", "nan", "NaN", "None", "null", "NULL", "<NA>", "N/A", "NA")
TRUE_TOKENS = ("true", "1", "yes", "y")
SUCCESS_TOKENS = ("success", "ok", "true", "1", "yes")


def text_of(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def is_blank(c: Column, tokens: tuple[str, ...] = (), ignore_case: bool = False) -> Column:
    """Null, nothing but blanks, or one of ``tokens``; never null itself."""
    t = text_of(c)
    if ignore_case:
        t, tokens = F.lower(t), tuple(x.lower() for x in tokens)
    return (t == "") | t.isin(*tokens) if tokens else t == ""


def is_true(c: Column) -> Column:
    return F.lower(text_of(c)).isin(*TRUE_TOKENS)


def number(c: Column, tokens: tuple[str, ...] = NUMBER_TOKENS) -> Column:
    """The column as double; tokens, NaN and what isn't a number are null."""
    t = F.trim(c.cast("string"))
    d = t.try_cast("double")
    return F.when(~t.isin(*tokens) & ~F.isnan(d), d)


def unparsable(c: Column, tokens: tuple[str, ...] = NUMBER_TOKENS) -> Column:
    """Something stands there that is no number."""
    t = F.trim(c.cast("string"))
    return t.isNotNull() & ~t.isin(*tokens) & t.try_cast("double").isNull()


def no_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where either is missing or b is 0."""
    return F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))


def delta(a: Column, b: Column) -> Column:
    return a.cast("double") - b.cast("double")
