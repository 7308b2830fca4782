"""Tokenising a text column, and the same on the driver for query strings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space tokens end at (no-break space is none).
SPACE = "[ \\t\\n\\x0B\\f\\r]"


def tokenize(text: Column, lower_case: bool = False) -> Column:
    """Tokens between white space. An empty text is one empty token, white space alone is none,
    leading white space leaves an empty first token, null is null."""
    t = F.lower(text) if lower_case else text
    trimmed = F.regexp_replace(t, rf"(?<=\S){SPACE}+$", "")
    return F.when(t.rlike(f"^{SPACE}+$"), F.expr("cast(array() as array<string>)")).otherwise(F.split(trimmed, f"{SPACE}+"))


def tokens_of(text: str, lower_case: bool = False) -> list[str]:
    """:func:`tokenize` of one string."""
    t = text.lower() if lower_case else text
    if re.fullmatch(f"{SPACE}+", t):
        return []
    parts = re.split(f"{SPACE}+", t)
    while len(parts) > 1 and not parts[-1]:
        parts.pop()
    return parts
