"""Plain forms of written posture states for the core queries (the llm operators have their own, finer reading)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_state(state: Column) -> Column:
    """Lower-case letters, other characters between them as one underscore; null without a letter."""
    s = F.regexp_replace(F.regexp_replace(F.lower(state), "[^a-z]+", "_"), "^_+|_+$", "")
    return F.when(s != "", s)
