"""Tokens of market searches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of no weight in market searches.
STOPWORDS = ("a", "an", "and", "for", "from", "in", "of", "on", "or", "the", "to", "with")


def market_tokens(text: Column) -> Column:
    """Distinct tokens of more than one character, without stop words."""
    clean = F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ")
    return F.array_distinct(F.filter(clean, lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS)))
