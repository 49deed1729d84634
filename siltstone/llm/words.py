"""Words `[^\\x20\\x09-\\x0D]+`, natively and inside Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column | str) -> Column:
    """Number of words; null text has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words_of(text: str | None) -> list[bytes]:
    """The words as UTF-8. `bytes.split()` cuts at exactly the six ASCII white-space characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []
