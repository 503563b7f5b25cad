"""Order-sensitive lowering that never gathers a whole sequence in one partition.

With a key, Spark windows do the work. Without one, the sequence is cut into ranges of its order at boundaries from a
bounded sample; each range is handled by a window of its own, and what earlier ranges contribute comes from a table of one
row a range. There are as many ranges as the session deals shuffles into (and RANGES at least), so they follow the input as that setting does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fewest and most ranges of a sequence without key, and sampled rows per range from which their boundaries come.
RANGES, MOST_RANGES, SAMPLED = 32, 4096, 20

#: How pairs of overlapping spans are joined: a cell of any size can spill, and a merge takes no longer than a hash join here.
JOIN = "merge"

#: Running aggregates: how to aggregate, and how to join what went before with what is in the range.
KINDS = {
    "sum": (F.sum, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)),
    "count": (F.count, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "last": (None, lambda a, b: F.coalesce(b, a)),
}


def range_of(df: DataFrame, order: Sequence[str]) -> Column:
    """The number of the range that a row falls into; a null first value falls into the first.

    Ranges end at sampled values of the first order column, or of all of them where one first value fills several ranges.
    """
    ranges = min(MOST_RANGES, max(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    place = F.struct(*(F.col(c).alias(f"o{k}") for k, c in enumerate(order)))
    found = df.where(F.col(order[0]).isNotNull()).select(place.alias("p"), F.xxhash64(*order).alias("r")).orderBy("r").limit(ranges * SAMPLED)
    # at most ranges * SAMPLED rows
    rows = [r["p"] for r in found.orderBy("p").collect()]
    cuts = rows[:: max(1, -(-len(rows) // ranges))][1:]
    if len({c[0] for c in cuts}) == len(cuts):
        at, ends = F.col(order[0]), [F.lit(c[0]) for c in cuts]
    else:
        kinds = dict(df.dtypes)
        cuts = [c for k, c in enumerate(cuts) if k == 0 or c != cuts[k - 1]]
        at, ends = place, [F.struct(*(F.lit(v).cast(kinds[n]).alias(f"o{k}") for k, (n, v) in enumerate(zip(order, c)))) for c in cuts]

    def halved(low: int, high: int) -> Column:
        """The number of the ends from low to high that the row has reached, by halving."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(at >= ends[middle], halved(middle + 1, high)).otherwise(halved(low, middle))

    return F.when(F.col(order[0]).isNull(), 0).otherwise(halved(0, len(ends)))


def ordering(order: Sequence[str], reverse: bool = False) -> list[Column]:
    return [F.col(c).desc_nulls_last() if reverse else F.col(c).asc_nulls_first() for c in order]


def running(df: DataFrame, order: Sequence[str], key: Sequence[str], items: Mapping[str, tuple[str, Column]], exclusive: bool = False, reverse: bool = False) -> DataFrame:
    """Add running aggregates: name -> (kind of KINDS, value). ``last`` skips nulls; exclusive leaves the row itself out."""
    frame = (Window.unboundedPreceding, -1 if exclusive else Window.currentRow)

    def local(kind: str, value: Column) -> Column:
        return F.last(value, ignorenulls=True) if kind == "last" else KINDS[kind][0](value)

    if key:
        over = Window.partitionBy(*key).orderBy(*ordering(order, reverse)).rowsBetween(*frame)
        return df.withColumns({name: local(kind, value).over(over) for name, (kind, value) in items.items()})
    df = df.withColumn("_range", range_of(df, order))
    over = Window.partitionBy("_range").orderBy(*ordering(order, reverse)).rowsBetween(*frame)
    place = F.struct(*order)

    def total(kind: str, value: Column) -> Column:
        pick = F.min_by if reverse else F.max_by
        return pick(value, F.when(value.isNotNull(), place)) if kind == "last" else KINDS[kind][0](value)

    sums = df.groupBy("_range").agg(*(total(kind, value).alias(f"_{name}") for name, (kind, value) in items.items()))
    # one row a range
    before = Window.orderBy(F.col("_range").desc() if reverse else F.col("_range")).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("_range", *(local(kind if kind != "count" else "sum", F.col(f"_{name}")).over(before).alias(f"_{name}") for name, (kind, _) in items.items()))
    inside = df.withColumns({name: local(kind, value).over(over) for name, (kind, value) in items.items()})
    joined = inside.join(F.broadcast(carried), "_range")
    return joined.withColumns({name: KINDS[kind][1](F.col(f"_{name}"), F.col(name)) for name, (kind, _) in items.items()}).drop("_range", *(f"_{n}" for n in items))


def numbered(df: DataFrame, order: Sequence[str], key: Sequence[str], name: str, reverse: bool = False) -> DataFrame:
    """Add the row's place in its sequence, from 0."""
    if key:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(*key).orderBy(*ordering(order, reverse))) - 1).cast("long"))
    return running(df, order, key, {name: ("count", F.lit(1))}, reverse=reverse).withColumn(name, (F.col(name) - 1).cast("long"))


def neighbour(df: DataFrame, order: Sequence[str], key: Sequence[str], items: Mapping[str, Column], after: bool = False) -> DataFrame:
    """Add the previous (or next) row's values, null at the end of the sequence."""
    if key:
        over = Window.partitionBy(*key).orderBy(*ordering(order))
        return df.withColumns({name: (F.lead if after else F.lag)(value).over(over) for name, value in items.items()})
    found = running(df, order, key, {name: ("last", F.struct(value.alias("v"))) for name, value in items.items()}, exclusive=True, reverse=after)
    return found.withColumns({name: F.col(f"{name}.v") for name in items})


def keyed_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join in which a null key meets a null key; the left side's key columns stay."""
    if not keys:
        raise ValueError("a key is required")
    renamed = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    return left.join(renamed, same_key(keys, "_k_"), how).drop(*(f"_k_{k}" for k in keys))


def same_key(keys: Sequence[str], prefix: str) -> Column:
    on = F.lit(True)
    for k, key in enumerate(keys):
        same = F.col(key).eqNullSafe(F.col(f"{prefix}{key}"))
        on = on & same if k else same
    return on


def stepped(df: DataFrame, order: Sequence[str], key: Sequence[str], inputs: Mapping[str, Column], start: Callable[[], Callable], name: str, kind: str = "long") -> DataFrame:
    """Add a column that a Python function works out row by row in order, with constant state: no key's rows are gathered.

    inputs: numbers (null: the smallest long). start() makes the function, which is told for a stretch of rows which of them begin a
    key, and a list for each input, and gives a list of values; it keeps its state between calls. One task handles a key, as the order demands.
    """
    own = Window.partitionBy(*key).orderBy(*ordering(order)) if key else Window.orderBy(*ordering(order))
    least = F.lit(-(1 << 63)).cast("long")
    given = {f"_in{k}": F.coalesce(value.cast("long"), least) for k, value in enumerate(inputs.values())}
    marked = df.withColumns(given | {"_begins": F.row_number().over(own) == 1})
    kept, told_names = [f for f in df.schema if f.name != name], ["_begins", *given]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            told = [batch.column(c).to_pylist() for c in told_names]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(np.array(step(*told), bool if kind == "boolean" else np.int64))], names=[*names, name])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{name}` {kind}"])
    return marked.mapInArrow(run, schema)


def tagged(parts: Mapping[str, DataFrame], shared: Sequence[str], tag: str = "_source") -> DataFrame:
    """One table of several sequences: the shared columns, a tag, and each part's columns in a struct named after it."""
    out = None
    kinds = {name: F.struct(*df.columns) for name, df in parts.items()}
    types = {name: df.select(kinds[name].alias("s")).schema["s"].dataType for name, df in parts.items()}
    for name, df in parts.items():
        row = df.select(*shared, F.lit(name).alias(tag), *((kinds[n] if n == name else F.lit(None).cast(types[n])).alias(n) for n in parts))
        out = row if out is None else out.unionByName(row)
    return out


class Spans:
    """What one pass over a side tells of its spans [start, end): where they start and how many there are of each length, by powers of two.

    Lengths fall into levels: the first reaches to eight times ``grain`` (a half to a quarter of the median length by default),
    each further one four times as far with cells four times as long, so that no span has more than ten cells of its own level.
    """

    def __init__(self, df: DataFrame, span: tuple[str, str]):
        self.start, self.end = (F.col(c) for c in span)
        kinds = dict(df.dtypes)
        self.whole = all(kinds[c] in ("tinyint", "smallint", "int", "bigint") for c in span)
        self.length = self.end - self.start
        self.some = self.start.isNotNull() & (self.end.isNull() | (self.length > 0))
        self.power = F.when(self.end.isNotNull(), F.floor(F.log2(F.greatest(self.length, F.lit(1)).cast("double")))).cast("int")
        # at most 64 rows and one of the spans without end
        found = df.where(self.some).groupBy(self.power.alias("p")).agg(F.min(self.start), F.max(self.start), F.max(self.length), F.count("*")).collect()
        self.firsts, self.lasts, self.rows = [r[1] for r in found], [r[2] for r in found], sum(r[4] for r in found)
        self.endless = any(r[0] is None for r in found)
        self.powers = {r[0]: r[4] for r in sorted((r for r in found if r[0] is not None), key=lambda r: r[0])}
        self.longest = {r[0]: r[3] for r in found if r[0] is not None}

    def median(self) -> int | None:
        """The power of two at or below the median of the lengths that end."""
        seen, half = 0, sum(self.powers.values()) / 2
        for power, n in self.powers.items():
            seen += n
            if seen >= half:
                return power
        return None

    def settle(self, first, last, grain: int | None) -> None:
        self.first, self.last = first, last
        reach, median = max(1, last - first + 1), self.median()
        if grain is None:
            grain = 2 ** max(0, median - 1) if median is not None else max(1, int(reach) // 4)
        self.grain, self.top = grain, 0
        while 8 * grain * 4**self.top < reach:
            self.top += 1

    def _level(self, power: int) -> int:
        level = 0
        while level < self.top and 2 ** (power + 1) > 8 * self.grain * 4**level:
            level += 1
        return level

    def levels(self, strict: bool) -> list[int]:
        """The levels in use; strict leaves out spans of one unit, which nothing starts strictly inside."""
        found = {self._level(p) for p in self.powers if not (strict and self.whole and p == 0)}
        return sorted(found | ({self.top} if self.endless else set()))

    def cell(self, at: Column, level: int | None = None) -> Column:
        """The cell of a time at a level, or at the row's own."""
        size = F.lit(float(self.grain * 4**level)) if level is not None else F.lit(float(self.grain)) * F.pow(F.lit(4.0), self.own())
        return F.floor((at - F.lit(self.first)) / size).cast("long")

    def own(self) -> Column:
        """The row's level."""
        level = F.lit(self.top)
        for power in reversed(self.powers):
            level = F.when(self.power <= power, self._level(power)).otherwise(level)
        return F.when(self.end.isNull(), self.top).otherwise(level)

    def lanes(self, side: int, strict: bool) -> Column:
        """(lane, cell) of every cell that the span has at its level."""
        some = self.some & (self.end.isNull() | (self.length > 1)) if strict and self.whole else self.some
        lane = (self.own() * 2 + side).cast("int")
        to = F.least(F.coalesce(self.end, F.lit(self.last)), F.lit(self.last))
        low = self.cell(self.start)
        held = F.transform(F.sequence(low, F.greatest(low, self.cell(to))), lambda c: F.struct(lane.alias("lane"), c.alias("cell")))
        return F.when(some, held).otherwise(F.array().cast("array<struct<lane:int,cell:bigint>>"))

    def points(self, start: Column, some: Column, side: int, strict: bool) -> Column:
        """(lane, cell) of a start of the other side, once for every level in use here."""
        held = [F.struct(F.lit(level * 2 + side).alias("lane"), self.cell(start, level).alias("cell")) for level in self.levels(strict)]
        none = F.array().cast("array<struct<lane:int,cell:bigint>>")
        return F.when(some, F.array(*held)).otherwise(none) if held else none


def _common(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> list[str]:
    """The types in which both sides' keys can be compared."""
    a, b = dict(left.dtypes), dict(right.dtypes)
    return [a[k] if a[k] == b[k] else left.sparkSession.range(0).select(F.coalesce(F.lit(None).cast(a[k]), F.lit(None).cast(b[k])).alias("c")).dtypes[0][1] for k in keys]


def _dealt(df: DataFrame, keys: Sequence[str], kinds: Sequence[str], place: Sequence[Column], name: str, parts: int) -> DataFrame:
    """Rows dealt by key and place. As fields of a struct null keys equal null keys; the number of parts is given, as the work grows with pairs, not with bytes."""
    here = F.struct(*(F.col(k).cast(t).alias(f"k{i}") for i, (k, t) in enumerate(zip(keys, kinds))), *(c.alias(f"p{i}") for i, c in enumerate(place)))
    return df.withColumn(name, here).repartition(parts, name)


def _parts(df: DataFrame, rows: int) -> int:
    return max(1, min(max(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), rows // 5_000))


def overlapping(left: DataFrame, right: DataFrame, keys: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str], how: str = "inner", grain: int | None = None) -> DataFrame:
    """Rows of both sides whose half-open spans meet: left.start < right.end and right.start < left.end, null end meaning never.

    Spans are numbers. Of two that meet, one starts in the other: a span lies in the few cells of its level (see Spans), a start in
    one cell of each level that the other side has, and they are joined by key, level and cell. So rows of a busy key meet only where
    they are near in time, long spans don't have more cells than short ones, and a pair is found once. An empty span, whose end
    isn't after its start, meets nothing. Null keys meet null keys. With how="left" each row of the left side that meets nothing
    comes once, repeated rows each for themselves.
    """
    (ls, le), (rs, re) = left_span, right_span
    a, b = Spans(left, left_span), Spans(right, right_span)
    return _overlapping(left, right, keys, a, b, how, grain)


def _overlapping(left: DataFrame, right: DataFrame, keys: Sequence[str], a: Spans, b: Spans, how: str, grain: int | None) -> DataFrame:
    first, last = min([*a.firsts, *b.firsts], default=0), max([*a.lasts, *b.lasts], default=0)
    a.settle(first, last, grain)
    b.settle(first, last, grain)
    outer, parts, kinds = how == "left", _parts(left, a.rows + b.rows), _common(left, right, keys)
    left_at = F.concat(a.lanes(0, False), b.points(a.start, a.some, 1, True))
    right_at = F.concat(a.points(b.start, b.some, 0, False), b.lanes(1, True))
    cut_left = left.withColumn("_row", F.monotonically_increasing_id()) if outer else left
    cut_left = cut_left.select("*", (F.posexplode_outer if outer else F.posexplode)(left_at).alias("_nth", "_at"))
    cut_right = right.select("*", F.explode(right_at).alias("_at"))
    cut_left = _dealt(cut_left, keys, kinds, [F.col("_at.lane"), F.col("_at.cell")], "_cell", parts).withColumn("_late", F.col("_at.lane") % 2 == 1).drop("_at")
    cut_right = _dealt(cut_right, keys, kinds, [F.col("_at.lane"), F.col("_at.cell")], "_cell_r", parts).drop("_at", *keys).withColumn("_met", F.lit(True))
    meets = ((b.start < a.end) | a.end.isNull()) & ((a.start < b.end) | b.end.isNull())
    pairs = cut_left.join(cut_right.hint(JOIN), (F.col("_cell") == F.col("_cell_r")) & (F.col("_late") == (a.start > b.start)) & meets, how)
    if outer:
        # a row's cells without a match go, but for one of a row that has none at all
        own = Window.partitionBy("_row")
        alone = F.max("_met").over(own).isNull() & (F.coalesce("_nth", F.lit(0)) == 0)
        pairs = pairs.withColumn("_alone", alone).where(F.col("_met").isNotNull() | F.col("_alone")).drop("_row", "_alone")
    return pairs.drop("_nth", "_cell", "_late", "_cell_r", "_met")


def grouped(left: DataFrame, right: DataFrame, keys: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str], value: Column, order: Sequence[str], name: str, grain: int | None = None) -> DataFrame:
    """Each row of the left side with the ordered list of the values of the right rows it meets (see overlapping); repeated rows stay as many as they are.

    Pairs are neither formed nor dealt: the right rows are gathered by key and cell, in every cell in which a left row that they
    may meet starts, and each left row filters the list of the one cell where it starts. That is for spans of up to four times the
    median length. Longer left rows, and all left rows if a right span is longer, form their pairs instead.
    """
    a, b = Spans(left, left_span), Spans(right, right_span)
    first = min([*a.firsts, *b.firsts], default=0)
    size = grain if grain is not None else 2 ** max(0, a.median() or 0, b.median() or 0)
    item = F.struct(*(F.col(c).alias(f"o{k}") for k, c in enumerate(order)), value.alias("v"), b.start.alias("s"), b.end.alias("e"))
    kind = right.select(value.alias("v")).dtypes[0][1]
    long_left = a.start.isNotNull() & (a.end.isNull() | (a.length > 4 * size))
    lengths = [n for n in a.longest.values()]
    some_long = a.endless or any(n > 4 * size for n in lengths)
    right_long = b.endless or any(n > 4 * size for n in b.longest.values())
    columns = left.columns

    def by_pairs(rows: DataFrame) -> DataFrame:
        # rows are told apart by a number, so that repeated rows stay as many as they are
        told = rows.withColumn("_nr", F.monotonically_increasing_id())
        joined = overlapping(told, right.select(*keys, item["s"].alias("_rs"), item["e"].alias("_re"), item.alias("_item")), keys, left_span, ("_rs", "_re"), "left", grain)
        gathered = joined.groupBy("_nr", *columns).agg(F.sort_array(F.collect_list("_item")).alias("_all"))
        return gathered.select(*columns, F.transform("_all", lambda x: x["v"]).alias(name))

    if right_long:
        return by_pairs(left)
    parts, kinds = _parts(left, a.rows + b.rows), _common(left, right, keys)
    farthest = min(4 * size, max(lengths, default=0))

    def cell(at: Column) -> Column:
        return F.floor((at - F.lit(first)) / F.lit(float(size))).cast("long")

    near = right.where(b.some).select(*keys, item.alias("_item"), F.explode(F.sequence(cell(b.start - F.lit(farthest)), cell(b.end))).alias("_at"))
    lists = _dealt(near, keys, kinds, [F.col("_at")], "_cell_r", parts).groupBy("_cell_r").agg(F.sort_array(F.collect_list("_item")).alias("_all"))
    short = left.where(~F.coalesce(long_left, F.lit(False))) if some_long else left
    dealt = _dealt(short, keys, kinds, [F.when(a.some, cell(a.start))], "_cell", parts)
    joined = dealt.join(lists.hint("merge"), (F.col("_cell") == F.col("_cell_r")) & a.some, "left")
    met = F.transform(F.filter("_all", lambda x: (x["s"] < a.end) & (a.start < x["e"])), lambda x: x["v"])
    found = joined.select(*columns, F.coalesce(met, F.array().cast(f"array<{kind}>")).alias(name))
    return found.unionByName(by_pairs(left.where(long_left))) if some_long else found
