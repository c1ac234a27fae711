"""String expressions the word and profile operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the signs deleted before words are counted.
WORD_COUNT_SIGNS = "([,.!?:;])"


def strip_blank(c: Column) -> Column:
    """All white space at either end, not only spaces."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def count_words(c: Column) -> Column:
    """Lower case, signs deleted, split on single spaces (line breaks stay inside tokens)."""
    return F.split(F.translate(F.lower(c), WORD_COUNT_SIGNS, ""), " ")


def ascii_words(c: Column) -> Column:
    """Lower case, everything but a-z taken as blank, split on runs of blanks, without empty tokens."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(c), "[^a-z]", " "), r"\s+"), "")
