"""Normal forms of names and codes."""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

from pyspark.sql import Column, functions as F


@functools.cache
def _marks() -> re.Pattern:
    """Runs of combining characters."""
    return re.compile("[" + "".join(chr(c) for c in range(0x300, sys.maxunicode + 1) if unicodedata.combining(chr(c))) + "]+")


def normalize(text: str | None) -> str | None:
    """Lower case, compatibility decomposition without combining marks, hyphens and slashes as spaces, single spaces. Greek stays."""
    if text is None:
        return None
    plain = text.lower()
    if not plain.isascii():
        plain = _marks().sub("", unicodedata.normalize("NFKD", plain))
    return " ".join(plain.replace("-", " ").replace("_", " ").replace("/", " ").split())


def normalized(col: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(normalize, na_action="ignore"), "string")(col)


def normalized_ascii(col: Column) -> Column:
    """The same for ASCII text, without leaving the JVM."""
    return F.trim(F.regexp_replace(F.lower(col), r"[-_/\s]+", " "))


def code(col: Column) -> Column:
    return F.lower(F.trim(col))


def chromosome(location: Column) -> Column:
    """1-22, 23 for X, 24 for Y, 25 for the mitochondrion, from a band such as 12p13.31 or a plain name; null for what isn't placed."""
    x = F.lower(F.trim(location))
    number = F.expr("NULL").cast("int")
    digits = F.regexp_extract(x, r"^(\d{1,9})", 1)
    number = F.when(digits != "", F.when(digits.cast("int").between(1, 22), digits.cast("int")))
    return F.when(x.isin("nan", "reserved", "", "-", "un", "unknown"), None).when(x.contains("mitochondria") | x.isin("mt", "m"), 25).when(x.startswith("x"), 23).when(x.startswith("y"), 24).otherwise(number)


def chromosome_label(label: Column) -> Column:
    """The same for sequence labels, which must be wholly a number, X, Y, M or MT after an optional chr."""
    x = F.upper(F.trim(F.regexp_replace(label, "chr", "")))
    return F.when(x == "X", 23).when(x == "Y", 24).when(x.isin("MT", "M"), 25).when(x.rlike(r"^\d{1,4}$"), F.when(x.try_cast("int").between(1, 22), x.try_cast("int")))
