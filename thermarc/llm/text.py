"""Column helpers shared by the text operators. All are built-in expressions, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"


def whole_text(col: str | Column = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words(text: Column) -> Column:
    """Runs of other characters than ASCII white space; an empty array for none."""
    bare = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, SPACES, -1))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (null ids count as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))
