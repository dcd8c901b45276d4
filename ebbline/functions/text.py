"""Text clean-up for display."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space of ASCII, the dashes a message may start with, and everything
# that is neither ASCII nor Latin letters (C0 to 24F).
WHITE_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"
LEADING_DASHES = " -–—"
OUTSIDE_LATIN = r"[^\x00-\x7FÀ-ɏ]+"
# The same with Latin Extended Additional (1E00 to 1EFF).
OUTSIDE_WIDER_LATIN = r"[^\x00-\x7FÀ-ɏḀ-ỿ]+"


def clean_display(text: Column, outside: str = OUTSIDE_LATIN) -> Column:
    """Drop symbols that match ``outside``, trim, drop leading dashes, trim again."""
    kept = F.btrim(F.regexp_replace(text, outside, ""), F.lit(WHITE_SPACE))
    undashed = F.ltrim(kept, F.lit(LEADING_DASHES))
    return F.btrim(undashed, F.lit(WHITE_SPACE))
