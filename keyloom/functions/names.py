"""What column names suggest, as columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens that many key columns share and that say nothing about what the key is of.
STOP_TOKENS = ("id", "no", "num", "number", "code", "key", "ref", "seq", "uid", "uuid", "guid")


def plain_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "")


def similarity_tokens(c: Column) -> Column:
    words = F.split(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2"), "[^A-Za-z0-9]+")
    return F.array_distinct(F.filter(F.transform(words, F.lower), lambda t: (t != "") & ~t.isin(list(STOP_TOKENS))))


def name_similarity(a: Column, b: Column) -> Column:
    """1 for equal names; else the overlap of their tokens, or 0.65 if one name holds the other; 0 if either has no telling token."""
    na, nb, ta, tb = plain_name(a), plain_name(b), similarity_tokens(a), similarity_tokens(b)
    inside = F.when(na.contains(nb) | nb.contains(na), 0.65).otherwise(0.0)
    shared = F.size(F.array_intersect(ta, tb)) / F.size(F.array_union(ta, tb))
    return F.when((na == "") | (nb == ""), 0.0).when(na == nb, 1.0).when((F.size(ta) == 0) | (F.size(tb) == 0), 0.0).otherwise(F.greatest(shared, inside))


def name_tokens(c: Column) -> Column:
    """Lower-case tokens, split at signs and within camel case."""
    s = F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.transform(F.split(s, "[^A-Za-z0-9]+"), F.lower), lambda t: t != "")


def has_token(tokens: Column, words: Iterable[str]) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, words)))


def has_part(c: Column, parts: Iterable[str]) -> Column:
    return F.lower(F.trim(c)).rlike("|".join(parts))


def ends_in_id(c: Column) -> Column:
    return F.lower(F.trim(c)).endswith("id")


def _name(c: Column) -> Column:
    return F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit("_"))


#: Parts of names, fixed values of the method.
NATURAL_PARTS = ("email", "e_mail", "phone", "mobile", "msisdn", "account", "acct", "username", "user_name")
BUSINESS_PARTS = ("invoice", "inv", "order_number", "ordernumber", "number", "code", "reference", "ref", "promo", "email")
DESCRIPTIVE_PARTS = ("name", "description", "title", "text", "notes", "comment", "message")
EXTERNAL_STRONG = ("barcode", "ean", "upc", "gtin", "isbn", "asin", "vin", "passport", "ssn", "nin", "tax", "vat", "utr")
EXTERNAL_MEDIUM = ("sku", "product_code", "item_code", "part_no", "part_number", "serial", "serial_no", "serial_number", "reference", "ref")


def id_like(c: Column) -> Column:
    return _name(c).rlike("_id$|^id$|uuid|^pk_|^fk_")


def natural_like(c: Column) -> Column:
    return _name(c).rlike("|".join(NATURAL_PARTS))


def surrogate_hint(c: Column) -> Column:
    s = F.lower(F.trim(c))
    return F.when(s == "id", 1.0).when(s.rlike("_id$|uuid|guid"), 0.7).otherwise(0.0)


def natural_hint(c: Column) -> Column:
    return F.when(has_part(c, EXTERNAL_STRONG), 1.0).when(has_part(c, EXTERNAL_MEDIUM), 0.6).otherwise(0.0)


def business_hint(c: Column) -> Column:
    return has_part(c, BUSINESS_PARTS)


def descriptive(c: Column) -> Column:
    return has_part(c, DESCRIPTIVE_PARTS)
