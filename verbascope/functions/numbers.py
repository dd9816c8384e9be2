"""Rounding that does not depend on the order of summing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added before rounding, so that a tie that binary fractions or the order of a sum leave just below is rounded up like an exact one.
NUDGE = 1e-9


def rounded(number: Column | str, places: int) -> Column:
    """`number` to `places`, at most 6; ties upwards."""
    return F.round((F.col(number) if isinstance(number, str) else number) + F.lit(NUDGE), places)


def rounded_sql(sql: str) -> str:
    """`sql` with every `round(x, n)` made to round as `rounded` does."""
    out, i = [], 0
    while (at := sql.find("round(", i)) >= 0:
        start = at + len("round(")
        depth, end = 1, start
        comma = None
        while depth:
            c = sql[end]
            depth += (c in "([") - (c in ")]")
            comma = end if c == "," and depth == 1 else comma
            end += 1
        out += [sql[i:start], "(", rounded_sql(sql[start:comma]), f") + {NUDGE}::double", sql[comma:end]]
        i = end
    return "".join([*out, sql[i:]])
