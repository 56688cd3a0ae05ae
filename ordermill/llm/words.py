"""Word expressions shared by the native operators."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay. ``lower`` does the same on plain ASCII, faster."""
    plain = F.octet_length(text) == F.char_length(text)
    every = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(plain, F.lower(text)).otherwise(every)


def words_between(text: Column, separators: str) -> Column:
    """The non-empty pieces between runs of the separator class; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")
