"""Rails: a sequence dealt to n parallel parts, named by a column, worked on apart and joined again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ordered_values
from ..plans.order import numbered

RAIL = "rail"


class Parallel:
    def parallel(self, n: int, rail: Column | None = None) -> Rails:
        """n rails; dealt by place in the sequence in turn, unless an expression names the rail (cheaper: no numbering)."""
        if n < 1:
            raise ValueError("at least one rail required")
        if rail is not None:
            return Rails(self.with_df(self.df.withColumn(RAIL, rail.cast("long"))), n)
        dealt = numbered(self.df, self.order, self.key, "_n").withColumn(RAIL, F.col("_n") % n).drop("_n")
        return Rails(self.with_df(dealt), n)


def from_sequences(*sequences) -> Rails:
    """Each sequence is a rail."""
    first = sequences[0]
    out = None
    for k, s in enumerate(sequences):
        df = s.df.withColumn(RAIL, F.lit(k).cast("long"))
        out = df if out is None else out.unionByName(df)
    return Rails(first.with_df(out), len(sequences))


class Rails:
    """Rows with a rail column. The rail is a partition hint, not a barrier: filters and maps need no shuffle."""

    def __init__(self, seq, n: int):
        self.seq, self.n = seq, n

    @property
    def df(self) -> DataFrame:
        return self.seq.df

    def _with(self, df: DataFrame, order=None) -> Rails:
        return Rails(self.seq.with_df(df, order=order), self.n)

    def run_on(self, partitions: int | None = None) -> Rails:
        """Rails to partitions: those of equal rail together."""
        return self._with(self.df.repartition(partitions or self.n, RAIL))

    def map(self, **columns: Column) -> Rails:
        return self._with(self.df.select(*self.seq.positions, *([RAIL] if RAIL not in self.seq.positions else []), *(c.alias(k) for k, c in columns.items())))

    def filter(self, test: Column) -> Rails:
        return self._with(self.df.where(test))

    def flat_map(self, values: Column, name: str = "value") -> Rails:
        return self._with(self.df.select(*self.seq.positions, RAIL, F.explode(values).alias(name)))

    def concat_map(self, values: Column, name: str = "value", position: str = "pos") -> Rails:
        return self._with(self.df.select(*self.seq.positions, RAIL, F.posexplode(values).alias(position, name)), order=(*self.seq.order, position))

    def do_on(self, name: str, *metrics: Column) -> Rails:
        return self._with(self.df.observe(name, *metrics))

    def compose(self, function: Callable):
        return function(self)

    as_ = compose

    def reduce(self, aggregate: Callable[[Column], Column], value: Column, name: str = "result") -> DataFrame:
        """All rails to one value by an associative aggregate; no rows give none."""
        return self.df.agg(F.count("*").alias("_n"), aggregate(value).alias(name)).where("_n > 0").drop("_n")

    def reduce_rails(self, aggregate: Callable[[Column], Column], value: Column, seed, join: Callable[[Column, Column], Column], name: str = "result") -> DataFrame:
        """A value for each rail, joined with the seed; the seed for an empty rail."""
        found = self.df.groupBy(RAIL).agg(aggregate(value).alias("_v"))
        rails = self.df.sparkSession.range(self.n).withColumnRenamed("id", RAIL)
        kind = dict(found.dtypes)["_v"]
        given = F.lit(seed).cast(kind)
        return rails.join(found, RAIL, "left").select(RAIL, F.when(F.col("_v").isNull(), given).otherwise(join(given, F.col("_v"))).alias(name))

    def collect(self, value: Column, name: str = "list") -> DataFrame:
        """The ordered list of each rail that has rows."""
        return self.df.groupBy(RAIL).agg(ordered_values(value, self.seq.order).alias(name))

    def collect_with(self, **collected: Column) -> DataFrame:
        return self.df.groupBy(RAIL).agg(*(c.alias(k) for k, c in collected.items()))

    def sequential(self):
        """The rails merged: by order, where rows carry one (they do)."""
        return self.seq.with_df(self.df.drop(RAIL))

    def sorted(self, *by: Column) -> DataFrame:
        """All rows in order of the given columns; ties go to the lower rail."""
        return self.df.orderBy(*by, RAIL, *self.seq.order)

    def to_sorted_list(self, value: Column, name: str = "list", descending: bool = False) -> DataFrame:
        return self.df.agg(F.sort_array(F.collect_list(value), asc=not descending).alias(name))

    def groups(self):
        """Each rail as a group keyed by its number."""
        return self.seq.with_df(self.df, key=(*self.seq.key, RAIL))

    def ordered(self, whole: bool = False, name: str = "index"):
        """Number the rows of each rail, or of the whole sequence, from 0."""
        key = list(self.seq.key) if whole else [*self.seq.key, RAIL]
        return Rails(self.seq.with_df(numbered(self.df, self.seq.order, key, name), order=(name,)), self.n)

    def unordered(self) -> DataFrame:
        return self.df
