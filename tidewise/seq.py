"""``Seq``: a DataFrame with an order and, optionally, a key that splits it into independent sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from .operators.aggregates import Aggregates
from .operators.combine import Combine
from .operators.errors import Errors
from .operators.filters import Filters
from .operators.flow import Flow
from .operators.multicast import Multicast
from .operators.parallel import Parallel
from .operators.project import Project
from .operators.running import Running
from .operators.sinks import Sinks
from .operators.timed import Timed
from .operators.windows import Windows
from .plans.order import numbered


class Seq(Project, Filters, Aggregates, Running, Combine, Windows, Timed, Errors, Multicast, Parallel, Flow, Sinks):
    """An ordered sequence of rows. Immutable: every operator returns a new one (or a DataFrame, where order ends).

    order: columns that order the rows; together with the key they should be unique, or ties fall as Spark likes.
    key: columns whose values separate sequences; an operator then works on each by itself.
    """

    def __init__(self, df: DataFrame, order: str | Sequence[str], key: str | Sequence[str] = ()):
        self.df = df
        self.order = (order,) if isinstance(order, str) else tuple(order)
        self.key = (key,) if isinstance(key, str) else tuple(key)
        if not self.order:
            raise ValueError("a sequence needs an order")
        if missing := [c for c in (*self.order, *self.key) if c not in df.columns]:
            raise ValueError(f"no such columns: {missing}")

    def with_df(self, df: DataFrame, order: Sequence[str] | None = None, key: Sequence[str] | None = None) -> Seq:
        return Seq(df, self.order if order is None else order, self.key if key is None else key)

    @property
    def positions(self) -> list[str]:
        """Key and order columns."""
        return [*self.key, *(c for c in self.order if c not in self.key)]

    @property
    def values(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.positions]

    def numbered(self, name: str = "place", reverse: bool = False) -> Seq:
        """With each row's place in its sequence, from 0 (from the end with reverse)."""
        return self.with_df(numbered(self.df, self.order, self.key, name, reverse))

    def __repr__(self) -> str:
        return f"Seq({self.df}, order={self.order}, key={self.key})"
