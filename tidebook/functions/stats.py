"""Statistics as column expressions where the built-in ones raise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def corr(a: str | Column, b: str | Column) -> Column:
    """Pearson's correlation of the rows that have both; null where one of them does not vary, instead of an error."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b)))
