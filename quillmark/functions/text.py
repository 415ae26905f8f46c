"""Column expressions over text; white space is ASCII white space."""

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
PIECE = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
TERM = r"[\p{L}\p{N}]+"
SENTENCE = r"[^.!?]+[.!?]*"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def pieces(text: Column) -> Column:
    """Words with the white space before them; joined they are the text up to its last word."""
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def sentences(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))
