"""Exact order statistics inside groups of any size.

Groups of up to ``TARGET_GROUP_ROWS`` rows take ordinary windows: one shuffle for a whole chain of steps, nothing run beforehand. Larger
ones take forms in which no task holds a whole group. ``by_size`` deals a chain of steps its groups: the input is written
once, the keys of large groups are looked up in it, and each part takes its form. A caller that knows a bound
of its groups names the form (``large=False`` or ``True``) and nothing is looked up.

A plan with both forms and no look-up would not do: each statistic that depends on another doubles the plan, as Spark's plans
are trees; a chain of six took half a minute to plan.

The forms for large groups: row numbers and ranks cut a group by hash-sampled splitters into ordered slices, as many as the
group's own size asks for, number them separately and shift them by the counts before them; quantiles come from a mergeable
sketch that brackets each of them, and only the few rows inside a bracket are ranked. Stages that are read several times are written."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import EPS
from ..session import cheap, durable, stage

TARGET_GROUP_ROWS = 1_000_000
OVERSAMPLE = 16
#: Steps of the sketch's grid and its accuracy: a bracket holds about six thousandths of a group.
GRID, ACCURACY = 1000, 10_000


def attach(df: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Null-safe join of per-key rows back to ``df``; Spark broadcasts or splits as sizes demand."""
    names = {k: f"__right_{i}" for i, k in enumerate(keys)}
    renamed = right.select(*[F.col(c).alias(names.get(c, c)) for c in right.columns])
    cond = F.lit(True)
    for k, r in names.items():
        cond = cond & F.col(k).eqNullSafe(F.col(r))
    joined = df.join(renamed, cond, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*names.values())


def by_size(df: DataFrame, keys: Sequence[str], steps: Callable[[DataFrame, bool], DataFrame], most: int | None = None) -> DataFrame:
    """``steps(rows, large)`` on the groups that fit a task (``large`` false) and on those that don't, united.

    A group fits up to ``most`` rows, ``TARGET_GROUP_ROWS`` if unsaid; the list of large groups has at most one row per so many rows."""
    base = stage(df)
    sizes = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size"))
    large = durable(sizes.where(F.col("__size") > (most or TARGET_GROUP_ROWS)).select(*keys, F.lit(1).alias("__large")))
    if large.isEmpty():
        return steps(base, False)
    few, many = (cheap(attach(base, F.broadcast(large), keys, how)) for how in ("left_anti", "left_semi"))
    return steps(few, False).unionByName(steps(many, True))


def sized(
    df: DataFrame, keys: Sequence[str], large: bool | None, steps: Callable[[DataFrame, bool], DataFrame], most: int | None = None
) -> DataFrame:
    """``steps`` in the form the caller names, or dealt out by size if it names none."""
    return by_size(df, keys, steps, most) if large is None else steps(df, large)


def places(values: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
    """Mean rank of ties as Spark orders doubles: NaN is equal to itself and above all. ``order`` sorts the values if it is known."""
    if order is None:
        order = np.argsort(values, kind="stable")
    v = values[order]
    first = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) & ~(np.isnan(v[1:]) & np.isnan(v[:-1]))])
    ties = np.diff(np.r_[first, len(v)])
    out = np.empty(len(v))
    out[order] = np.repeat(first + (ties + 1) / 2.0, ties)
    return out


def correlation(s: np.ndarray, y: np.ndarray) -> float | None:
    """Correlation of two sets of mean ranks; None when either is constant."""
    n = len(s)
    s, y = s - (n + 1) / 2.0, y - (n + 1) / 2.0
    sx, sy = (np.sqrt(np.dot(v, v) / n) if n else 0.0 for v in (s, y))
    return float(np.dot(s, y) / n / (sx * sy)) if sx > EPS and sy > EPS else None


def _slice_number(ordered: Column, edges: Column) -> Column:
    """Number of edges at or below ``ordered``: a binary search over a sorted array."""

    def narrow(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        below = F.element_at(edges, mid + 1) <= ordered
        return F.when(acc["lo"] >= acc["hi"], acc).otherwise(
            F.struct(
                F.when(below, mid + 1).otherwise(acc["lo"]).alias("lo"),
                F.when(below, acc["hi"]).otherwise(mid).alias("hi"),
            )
        )

    start = F.struct(F.lit(0).alias("lo"), F.size(edges).alias("hi"))
    steps = F.ceil(F.log2(F.size(edges) + 1.0)).cast("int") + 1
    return F.aggregate(F.sequence(F.lit(1), steps), start, narrow)["lo"]


def cut_into_slices(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``__slice``: ordered, near-equal pieces of every group, decided by the rows alone.

    A group gets one slice for each ``TARGET_GROUP_ROWS`` rows it has. ``order`` must end in columns that make rows of a
    group distinct, so that even a group of equal values is cut."""
    keys = list(keys)
    base = stage(df)
    ordered = F.struct(*order).alias("__ord")
    sizes = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size"))
    slices = F.ceil(F.col("__size") / float(TARGET_GROUP_ROWS))
    stride = F.greatest(F.lit(1), F.floor(F.col("__size") / (slices * OVERSAMPLE)))
    sampled = attach(base.select(*keys, ordered), sizes, keys, "inner").where(F.pmod(F.xxhash64("__ord"), stride) == 0)
    edges = durable(sampled.groupBy(*keys).agg(
        F.filter(F.sort_array(F.collect_list("__ord")), lambda x, i: (i + 1) % OVERSAMPLE == 0).alias("__edges")
    ))
    empty = F.filter(F.array("__ord"), lambda x: F.lit(False))
    joined = attach(base.select("*", ordered), edges, keys).withColumn("__edges", F.coalesce("__edges", empty))
    return cheap(joined.withColumn("__slice", _slice_number(F.col("__ord"), F.col("__edges"))).drop("__edges"))


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "row_no", size: str = "group_n", large: bool | None = None
) -> DataFrame:
    """Row number (1-based) by ``order`` and group size. The last order column breaks ties."""
    keys = list(keys)

    def steps(d: DataFrame, large: bool) -> DataFrame:
        if not large:
            w = Window.partitionBy(*keys)
            return d.withColumn(out, F.row_number().over(w.orderBy(*order)).cast("long")).withColumn(size, F.count(F.lit(1)).over(w))
        cut = cut_into_slices(d, keys, order)
        totals = cut.groupBy(*keys, "__slice").agg(F.count(F.lit(1)).alias("__c"))
        wk = Window.partitionBy(*keys)  # about two rows per slice of a key
        totals = durable(totals.select(  # written: its size then is known, and no row moves to meet it
            *keys, "__slice", (F.sum("__c").over(wk.orderBy("__slice")) - F.col("__c")).alias("__before"), F.sum("__c").over(wk).alias(size)
        ))
        local = cut.drop("__ord").withColumn("__local", F.row_number().over(Window.partitionBy(*keys, "__slice").orderBy(*order)))
        return attach(local, totals, [*keys, "__slice"], "inner").select(
            *d.columns, (F.col("__before") + F.col("__local")).cast("long").alias(out), F.col(size).cast("long").alias(size)
        )

    return sized(df, keys, large, steps)


def average_rank(
    df: DataFrame, keys: Sequence[str], value: str, out: str, tie_break: Sequence[str] = (), large: bool | None = None
) -> DataFrame:
    """Mean rank of ties among the present values; NULL stays NULL.

    ``out`` is the rank, ``{out}_n`` the number of present values of the group.
    ``tie_break`` is only needed to cut groups into slices.
    """
    keys = list(keys)

    def steps(d: DataFrame, large: bool) -> DataFrame:
        if not large:
            w = Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last())
            ties = F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow))
            rank = F.rank().over(w) + (ties - 1) / F.lit(2.0)
            return d.withColumn(out, F.when(F.col(value).isNotNull(), rank)).withColumn(
                f"{out}_n", F.count(value).over(Window.partitionBy(*keys))
            )
        src = stage(d)
        present = cheap(src.where(F.col(value).isNotNull()).select(*dict.fromkeys([*keys, value, *tie_break])))
        ranked = numbered(present, keys, list(dict.fromkeys([value, *tie_break])), "__r", "__n", True)
        levels = ranked.groupBy(*keys, value).agg(((F.min("__r") + F.max("__r")) / 2.0).alias(out))
        per_group = present.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
        return attach(attach(src, levels, [*keys, value]), per_group, keys).select(
            *src.columns, out, F.coalesce("__n", F.lit(0)).cast("long").alias(f"{out}_n")
        )

    return sized(df, keys, large, steps)


def _bracketed(df: DataFrame, keys: Sequence[str], values: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Quantiles of large groups in three passes that combine before they shuffle: a sketch, counts below brackets, the rows inside.

    The sketch is off by at most one in ``ACCURACY`` of a group, a bracket spans more than two steps of the grid and two
    rows on either side, so the wanted rows lie inside whatever the sketch did."""
    by = [*keys, "__name"]
    named = F.explode(F.array(*[F.struct(F.lit(v).alias("__name"), F.col(v).cast("double").alias("__v")) for v in values]))
    long = durable(df.select(*keys, named.alias("__f")).select(*keys, "__f.__name", "__f.__v").where(F.col("__v").isNotNull()))
    grid = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    sketch = long.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.approx_percentile("__v", grid, ACCURACY).alias("__g"))
    off = F.ceil(F.lit(2.0 * GRID) / F.col("__n")).cast("int") + 2
    marks = []
    for i, p in enumerate(probs):
        low, high = F.lit(math.floor(p * GRID)) - off, F.lit(math.ceil(p * GRID)) + off
        marks.append(F.when(low >= 0, F.get("__g", low)).otherwise(F.lit(float("-inf"))).alias(f"__lo{i}"))
        marks.append(F.when(high <= GRID, F.get("__g", high)).otherwise(F.lit(float("inf"))).alias(f"__hi{i}"))
    brackets = durable(sketch.select(*by, "__n", *marks))
    met = attach(long, brackets, by, "inner")
    below = met.groupBy(*by).agg(*[F.count_if(F.col("__v") < F.col(f"__lo{i}")).alias(f"__b{i}") for i in range(len(probs))])
    inside = F.filter(
        F.array(*[F.when(F.col("__v").between(F.col(f"__lo{i}"), F.col(f"__hi{i}")), F.lit(i)) for i in range(len(probs))]), lambda x: x.isNotNull()
    )
    rows = met.select(*by, "__v", "__n", F.explode(inside).alias("__i"))
    rows = rows.withColumn("__k", F.row_number().over(Window.partitionBy(*by, "__i").orderBy("__v")))
    rows = attach(rows, below, by, "inner")
    picks, out = [], []
    for i, p in enumerate(probs):
        pos = (F.col("__n") - 1) * F.lit(float(p))
        at = (F.col("__i") == i) & (F.col("__k") + F.col(f"__b{i}") == F.floor(pos) + 1)
        up = (F.col("__i") == i) & (F.col("__k") + F.col(f"__b{i}") == F.ceil(pos) + 1)
        picks += [F.max(F.when(at, F.col("__v"))).alias(f"__x{i}"), F.max(F.when(up, F.col("__v"))).alias(f"__y{i}")]
        out.append(F.col(f"__x{i}") + (F.col(f"__y{i}") - F.col(f"__x{i}")) * (pos - F.floor(pos)))
    return rows.groupBy(*by).agg(F.max("__n").alias("__n"), *picks).select(*by, "__n", F.array(*out).alias("__q"))


def group_quantiles(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], probs: Sequence[float], large: bool | None = None
) -> DataFrame:
    """Exact linear quantiles per group: one row per group with ``{v}_q`` arrays and ``{v}_c`` counts.

    A value that no row of a group has gives NULL and 0 in groups that fit a task; large groups without
    any present value are left out."""
    keys = list(keys)
    wanted = F.array(*[F.lit(float(p)) for p in probs])

    def steps(d: DataFrame, large: bool) -> DataFrame:
        if not large:
            aggs = [F.percentile(v, wanted).alias(f"{v}_q") for v in values]
            small = d.groupBy(*keys).agg(*aggs, *[F.count(v).alias(f"{v}_c") for v in values], F.count(F.lit(1)).alias("__rows"))
            return small.where(F.col("__rows") > 0).drop("__rows")  # pooled rows may be none
        stats = _bracketed(d, keys, values, probs)
        of = {v: F.col("__name") == v for v in values}
        aggs = [F.max(F.when(of[v], F.col("__q"))).alias(f"{v}_q") for v in values]
        aggs += [F.coalesce(F.max(F.when(of[v], F.col("__n"))), F.lit(0)).cast("long").alias(f"{v}_c") for v in values]
        wide = stats.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("__rows"))
        return wide.where(F.col("__rows") > 0).drop("__rows")

    return sized(df.select(*dict.fromkeys([*keys, *values])), keys, large, steps)
