"""Which slots of a series an expression reads, derived while it is built.

A ``Seen`` is a column together with its reach: the nearest and the farthest
slot of the load that its value depends on, counted from its own row (0 the row
itself, -672 a week back, minus infinity the beginning of the series).  Lags and
frames shift the reach, arithmetic unites it; so what a feature reads is not
declared beside its expression but follows from it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import inf

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Reach:
    """Slots from ``far`` to ``near``; both zero or negative in a feature that reads no later slot."""

    far: float
    near: float

    def shifted(self, far: float, near: float) -> Reach:
        """The reach of rows from ``far`` to ``near`` that have this one each."""
        return Reach(self.far + far, self.near + near)

    def with_(self, other: Reach) -> Reach:
        return Reach(min(self.far, other.far), max(self.near, other.near))


def united(*reaches: Reach | None) -> Reach | None:
    out: Reach | None = None
    for r in reaches:
        out = r if out is None else out if r is None else out.with_(r)
    return out


@dataclass(frozen=True)
class Seen:
    """``reach`` is None where no load is read (clocks, constants)."""

    column: Column
    reach: Reach | None

    def lag(self, n: int, over: WindowSpec) -> Seen:
        return Seen(F.lag(self.column, n).over(over) if n else self.column, self.reach and self.reach.shifted(-n, -n))

    def frame(self, fold: Callable[[Column], Column], over: WindowSpec, far: float, near: int) -> Seen:
        """``fold`` over the rows from ``far`` (minus infinity: the first) to ``near``."""
        rows = over.rowsBetween(over_start(far), near)
        return Seen(fold(self.column).over(rows), self.reach and self.reach.shifted(far, near))


def over_start(far: float) -> int:
    from pyspark.sql import Window

    return Window.unboundedPreceding if far == -inf else int(far)


def combine(build: Callable[..., Column], *parts: Seen) -> Seen:
    """A row-local expression of the parts."""
    return Seen(build(*[p.column for p in parts]), united(*[p.reach for p in parts]))


class Stages:
    """A frame that grows by stages of named expressions, and each name's reach.
    Without a frame only the reaches are kept."""

    def __init__(self, df: DataFrame | None, reach: dict[str, Reach | None]):
        self.df, self.reach = df, dict(reach)

    def __getitem__(self, name: str) -> Seen:
        return Seen(F.col(name), self.reach[name])

    def add(self, named: dict[str, Seen]) -> Stages:
        df = self.df if self.df is None or not named else self.df.select("*", *[s.column.alias(n) for n, s in named.items()])
        return Stages(df, self.reach | {n: s.reach for n, s in named.items()})
