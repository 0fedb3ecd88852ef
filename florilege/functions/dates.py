"""Season, phase of the month and folk days near a date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from florilege.functions import rules


def phase(day: Column) -> Column:
    n = F.dayofmonth(day)
    return F.when(n <= 10, "początek").when(n <= 20, "połowa").otherwise("koniec")


def season(day: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in rules.SEASONS]), F.month(day))


def folk_days_near(day: Column, before: int = 7, after: int = 3) -> Column:
    """Names of folk days that start within a week or ended up to three days ago, across year ends."""
    found = []
    for month, first, last, name in rules.FOLK_DAYS:
        near = F.lit(False)
        for shift in (-1, 0, 1):
            start = F.make_date(F.year(day) + shift, F.lit(month), F.lit(first))
            end = F.make_date(F.year(day) + shift, F.lit(month), F.lit(last))
            near = near | ((F.datediff(start, day) <= before) & (F.datediff(day, end) <= after))
        found.append(F.when(near, name))
    return F.array_distinct(F.array_compact(F.array(*found)))
