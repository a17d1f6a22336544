"""As-of semantics: reporting periods and one-pass conditional aggregation over them.

The KPI snapshots for today and for 7, 30 and 365 days ago are computed in ONE aggregation with
one conditional aggregate per (period, measure). Nothing is exploded or cross-joined: the
aggregate yields a single wide row (or one per group), which ``inline`` turns into one row per
period afterwards. Measures are SQL expressions: hundreds of them cost one parse each, not a call
into the JVM per operator.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Look-back of the historical snapshots, in days.
LOOKBACK_DAYS = {"last_week": 7, "last_month": 30, "last_year": 365}


@dataclass(frozen=True)
class Period:
    """A snapshot. ``current`` takes the tables as recorded; the others take them as of ``ref``."""

    name: str
    ref: dt.date
    current: bool = False

    @property
    def date(self) -> str:
        return f"DATE'{self.ref}'"

    def happened(self, date: str) -> str:
        """The fact dated ``date`` belongs to the snapshot (every fact does for ``current``)."""
        return "true" if self.current else f"coalesce({date} <= {self.date}, false)"

    def ended(self, date: str) -> str:
        """The end ``date`` has been reached (any recorded end counts for ``current``)."""
        return f"({date} IS NOT NULL)" if self.current else f"coalesce({date} <= {self.date}, false)"


def periods(as_of: dt.date) -> list[Period]:
    past = [Period(n, as_of - dt.timedelta(days=d)) for n, d in LOOKBACK_DAYS.items()]
    return [Period("current", as_of, current=True), *past]


def aggregate_points(
    df: DataFrame, points: Sequence[tuple[str, dict[str, str]]], label: str, by: Sequence[str] = ()
) -> DataFrame:
    """One aggregation for all points, returned as one row per (group, point).

    ``points`` pairs a SQL literal with its named SQL aggregates; every point names the same
    aggregates.
    """
    names = list(points[0][1])
    aggs = [f"{e} AS `{i}_{n}`" for i, (_, ms) in enumerate(points) for n, e in ms.items()]
    wide = df.groupBy(*by).agg(*[F.expr(a) for a in aggs]) if by else df.selectExpr(*aggs)
    rows = [
        f"named_struct('{label}', {value}, " + ", ".join(f"'{n}', `{i}_{n}`" for n in names) + ")"
        for i, (value, _) in enumerate(points)
    ]
    return wide.selectExpr(*by, f"inline(array({', '.join(rows)}))")


def by_period(
    df: DataFrame,
    as_of: dt.date,
    measures: Callable[[Period], dict[str, str]],
    by: Sequence[str] = (),
) -> DataFrame:
    return aggregate_points(df, [(f"'{p.name}'", measures(p)) for p in periods(as_of)], "period", by)
