"""Keys as they are meant: without stray blanks, and null where nothing is left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks at either end, in Java's and RE2's syntax alike.
EDGE_BLANKS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def clean_key(key: Column) -> Column:
    """`key` without blanks at either end; null if it is null, empty or blanks only."""
    bare = F.regexp_replace(key, EDGE_BLANKS, "")
    return F.when(bare != "", bare)


def page_of(docid: Column) -> Column:
    """The page of a `page#passage` docid; null for a null or blank docid."""
    return F.substring_index(clean_key(docid), "#", 1)


def clean_key_sql(expression: str) -> str:
    """`clean_key` in DuckDB's SQL."""
    return rf"nullif(regexp_replace({expression}, '{EDGE_BLANKS}', '', 'g'), '')"
