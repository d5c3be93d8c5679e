"""Text normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that ``clean`` strips from both ends: the ASCII white space and the no-break spaces.
SPACE = " \t\n\r\x0b\x0c\u00a0\u202f\ufeff"


def clean(column: Column | str) -> Column:
    """Strip white space from both ends; null stays null."""
    return F.trim(F.col(column) if isinstance(column, str) else column, F.lit(SPACE))


def folded(column: Column | str) -> Column:
    """``clean`` in lower case: the form in which hashes, ids and names compare."""
    return F.lower(clean(column))
