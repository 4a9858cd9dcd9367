"""Small helpers for expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.arrays import let, running

__all__ = ["BLANKS", "BLANK_CHARS", "let", "running", "without", "words"]
BLANKS = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\u000b\f\r"


def words(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS, -1), lambda w: w != "")


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")
