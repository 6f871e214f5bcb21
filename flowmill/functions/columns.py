"""Column helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a, b) -> Column:
    """a / b, and 0 where b is 0 or either is null."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def reasons(*checks: tuple[Column, str]) -> Column:
    """The texts of the checks that hold, in their order."""
    return F.array_compact(F.array(*(F.when(bad, F.lit(text)) for bad, text in checks)))


def first_reason(*checks: tuple[Column, str]) -> Column:
    return F.coalesce(*(F.when(bad, F.lit(text)) for bad, text in checks))


def folded(name) -> Column:
    """A name in lower case without anything but letters and digits."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "")


def rounded(df, *names: str, places: int = 6):
    return df.withColumns({n: F.round(n, places) for n in names})
