"""Null tokens, integer-likeness and key representations, as columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import MEMORY_NULLS, SQL_NULLS

_SPACE = r"[ \t\n\r\f\x0B]+"


def strip(c: Column) -> Column:
    """Without white space of any kind around it."""
    return F.regexp_replace(c, rf"^{_SPACE}|{_SPACE}$", "")


def memory_clean(c: Column, tokens: Iterable[str] = MEMORY_NULLS) -> Column:
    """Null where the text is a null token; otherwise the text as it is."""
    text = c.cast("string")
    return F.when(~F.lower(strip(F.regexp_replace(text, _SPACE, " "))).isin(list(tokens)), text)


def sql_clean(c: Column, tokens: Iterable[str] = SQL_NULLS) -> Column:
    """Null where the trimmed text is a null token; otherwise the trimmed text."""
    text, tokens = F.trim(c.cast("string")), list(tokens)
    longer = F.octet_length(text) > max(len(t.encode()) for t in tokens)  # most are: they needn't be lower-cased
    return F.when(longer | ~F.lower(text).isin(tokens), text)


def int_like(c: Column, atol: float = 1e-8) -> Column:
    """Whether a double is close to an integer: the tolerance also grows with the value."""
    return F.abs(c - F.rint(c)) <= F.lit(atol) + F.lit(1e-5) * F.abs(F.rint(c))


def key_text(c: Column, family: str, all_int: bool = False) -> Column:
    """A key as comparable text: numbers of an all-integer column without a fraction, other values stripped."""
    if family in ("int", "float") and all_int:
        return F.rint(c.cast("double")).cast("long").cast("string")
    return strip(memory_clean(c))


def to_number(c: Column) -> Column:
    return strip(c).try_cast("double")


def raw_rep(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def int_rep(c: Column, max_abs: int) -> Column:
    """Integer-like numeric text as an integer's text; null for other text."""
    x = to_number(c)
    return F.when(int_like(x, 1e-9) & (F.abs(F.rint(x)) <= max_abs), F.rint(x).cast("long").cast("string"))


def is_digits(c: Column) -> Column:
    return strip(c).rlike("^[0-9]+$")


def no_zeros_rep(c: Column) -> Column:
    """Digits without leading zeros; null for other text."""
    return F.when(is_digits(c), F.regexp_replace(strip(c), "^0+(?=.)", ""))


def zfill_rep(c: Column, width: Column) -> Column:
    """Digits padded with zeros to a width, never cut; other text as it is."""
    s = raw_rep(c)
    return F.when(is_digits(c), F.lpad(s, F.greatest(F.length(s), width), F.lit("0"))).otherwise(s)


def numeric_tokens(c: Column) -> Column:
    """Numeric text without currency signs, percent signs and separators; (x) is negative."""
    s = F.replace(strip(c), F.lit("\u2212"), F.lit("-"))
    s = F.regexp_replace(s, r"^\((.*)\)$", "-$1")
    return F.regexp_replace(s, r"[$£€¥%,_\s\xA0]", "")
