"""Text widths in code points; padding never cuts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utf8_length(text: Column) -> Column:
    return F.char_length(text)


def pad_right(text: Column, width: int) -> Column:
    return F.when(F.char_length(text) >= width, text).otherwise(F.rpad(text, width, " "))


def pad_left(text: Column, width: int) -> Column:
    return F.when(F.char_length(text) >= width, text).otherwise(F.lpad(text, width, " "))
