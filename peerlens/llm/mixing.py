"""Mixing sources to target weights by entropy balancing.

Each document gets a rate, the number of times it should be taken. Among all rates that meet the token target of every source and
stay within 0 and the limit on repeats, those of least divergence from 1 are ``min(limit, exp(lambda * size / mean size))``: an
exponential tilt per source. The convex dual is solved for all sources at once by Newton steps on the logarithm of the
constraint, kept inside a bracket; each step is one aggregate over the corpus, reduced beforehand to (source, size,
count). Rates are rounded into whole copies by cumulative rounding in the order of size, so what is lost
on one size is given back at the next; what then remains is settled by a few documents of fitting size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peerlens.llm.common import durable, free_name, number_in_class, quoted, raw_bytes, table

LIMIT = 3
WEIGHTS = (1, 2, 3)
TOLERANCE = 1e-9
MAX_STEPS = 60


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes = [len(t.split()) if t else 0 for t in raw_bytes(b.column("text"))]
        rest = b.drop_columns(["text"])
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(sizes, pa.int64())], [*rest.schema.names, "size"])


def word_sizes(docs: DataFrame) -> DataFrame:
    """(row, doc_id, source, size): size is the number of runs of ``[^\\x20\\x09-\\x0D]``, 0 for a null text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", "text")
    return rows.mapInArrow(_word_counts, f"row bigint, doc_id {kind}, source string, size bigint")


def source_targets(classes: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """(sid, source, source_size, n_docs, target): one row per source, in code point order, null last.

    Targets share the whole size by weight; none passes ``limit`` times its source, and what is over goes to the
    others by weight. That is min(limit * size, weight * level) with the level that uses up the whole; the level is
    the largest found when the sources are filled in the order of limit * size / weight. The window sees one row per source."""
    sums = classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    numbered = sums.withColumn("sid", F.row_number().over(by_name) - 1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = numbered.withColumn("weight", F.element_at(cycle, F.col("sid") % len(weights) + 1)).withColumn("cap", F.lit(float(limit)) * F.col("source_size"))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    every = filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    share = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = weighed.withColumn("level", left / share).withColumn("level", F.max("level").over(every))
    return level.select("sid", "source", "source_size", "n_docs", F.least("cap", F.col("weight") * F.col("level")).alias("target"))


def solve_tilts(classes: DataFrame, sources: DataFrame, limit: float = LIMIT) -> DataFrame:
    """(sid, tilt, mean, target) of every source that has words: Newton on the dual, one aggregate a step.

    ``classes``: (sid, size, n) with size > 0. The bracket is exact: at its upper end every document is
    at the limit, at its lower end even the shortest ones fall short of the target."""
    mean = F.col("source_size") / F.col("n_docs")
    spread = F.greatest(mean, F.lit(1.0))
    state = durable(
        sources.where("source_size > 0").select(
            "sid", "target", spread.alias("mean"), F.lit(0.0).alias("tilt"),
            (spread * F.least(F.lit(0.0), F.log(F.col("target") / F.col("source_size"))) - 1).alias("low"),
            (spread * float(np.log(limit)) + 1).alias("high"),
        )
    )
    for _ in range(MAX_STEPS):
        x = F.col("size") / F.col("mean")
        free = F.exp(F.least(F.col("tilt") * x, F.lit(float(np.log(limit)) + 1)))
        mass = F.col("n") * F.col("size") * F.least(free, F.lit(float(limit)))
        slope = F.when(free < limit, mass * x).otherwise(0.0)
        sums = classes.join(state, "sid").groupBy("sid").agg(F.sum(mass).alias("mass"), F.sum(slope).alias("slope"))
        over = F.col("mass") > F.col("target")
        low, high = F.when(over, F.col("low")).otherwise(F.col("tilt")), F.when(over, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - F.log(F.col("mass") / F.col("target")) * F.col("mass") / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > low) & (newton < high)
        gap = F.abs(F.col("mass") / F.col("target") - 1)
        stepped = state.join(sums, "sid").select(
            "sid", "target", "mean", low.alias("low"), high.alias("high"), gap.alias("gap"),
            F.when(gap <= TOLERANCE, F.col("tilt")).when(inside, newton).otherwise((low + high) / 2).alias("tilt"),
        )
        state = durable(stepped)
        worst = state.agg(F.max("gap")).first()[0]
        if worst is None or worst <= TOLERANCE:
            break
    return state.select("sid", "tilt", "mean", "target")


def _swaps(size: np.ndarray, n: np.ndarray, copies: np.ndarray, rest: float, limit: int, most: int = 16) -> float:
    """One copy more of one size for one less of another (or for none), as long as that comes nearer to the target."""
    for _ in range(most):
        up = np.flatnonzero(copies < limit * n)
        down = np.concatenate((np.flatnonzero(copies > 0), [-1]))  # -1: none
        if not len(up):
            return rest
        less = np.append(size, 0)[down]
        want = less + rest
        at = np.searchsorted(size[up], want)
        best = (abs(rest), -1, -1)
        for side in (np.clip(at - 1, 0, len(up) - 1), np.clip(at, 0, len(up) - 1)):
            gap = np.abs(want - size[up][side])
            k = int(gap.argmin())
            best = min(best, (float(gap[k]), int(up[side[k]]), int(down[k])))
        gap, more, fewer = best
        if more < 0 or gap >= abs(rest):
            return rest
        copies[more] += 1
        rest -= float(size[more])
        if fewer >= 0:
            copies[fewer] -= 1
            rest += float(size[fewer])
    return rest


def round_copies(group: pd.DataFrame, limit: int) -> pd.DataFrame:
    """Whole copies of each (size, n, rate) class of a source.

    Cumulative rounding loses at most one document of the largest size; classes of fitting size, then swaps of single copies,
    bring the words of the source close to its target. The group has one row per distinct size, at most as many as the longest document has words."""
    g = group.sort_values("size")
    size, n, target = g["size"].to_numpy(), g["n"].to_numpy(), float(g["target"].iloc[0])
    total = np.floor(np.cumsum(n * g["rate"].to_numpy()) + 0.5)
    copies = np.clip(np.diff(total, prepend=0.0), 0, limit * n).astype(np.int64)
    rest = target - float((copies * size).sum())
    for i in range(len(size) - 1, -1, -1):
        room = limit * n[i] - copies[i] if rest > 0 else copies[i]
        step = min(int(abs(rest) // size[i]), int(room))
        copies[i] += step if rest > 0 else -step
        rest -= step * float(size[i]) * (1 if rest > 0 else -1)
    _swaps(size, n, copies, rest, limit)
    return pd.DataFrame({"sid": g["sid"].to_numpy(), "size": size, "copies": copies})


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, rate, row.

    ``taken`` is copies times size, at most ``limit`` times size. Documents without words have no copies
    (nothing of them can be taken) and rate 0; a null source is a source. Copies of a class go to its documents in the order of a hash of
    doc_id, so reruns agree on any layout of the files. Repeated rows count by themselves; an empty table gives no rows. ``docs`` is read
    again where copies are joined to texts, so it should be a table that gives its rows in the same order."""
    sized = durable(word_sizes(docs))
    classes = durable(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    sources = durable(source_targets(classes, weights, limit))
    by_source = classes["source"].eqNullSafe(sources["source"])
    known = durable(classes.join(sources, by_source).where("size > 0").select("sid", "size", "n"))
    tilts = solve_tilts(known, sources, limit)
    rate = F.least(F.lit(float(limit)), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(50.0))))
    rated = durable(known.join(tilts, "sid").select("sid", "size", "n", "target", rate.alias("rate")))
    copies = rated.groupBy("sid").applyInPandas(lambda g: round_copies(g, limit), "sid int, size bigint, copies bigint")
    plan = durable(rated.join(copies, ["sid", "size"]).select("sid", "size", "n", "rate", "copies"))
    placed = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).select("row", "doc_id", "sid", "size", "source_size", "target")
    with_plan = durable(placed.join(plan, ["sid", "size"], "left"))
    numbered = number_in_class(with_plan, ["sid", "size"], ["doc_id"], "no")
    own = F.floor(F.col("copies") / F.col("n")) + (F.col("no") < F.col("copies") % F.col("n")).cast("long")
    own = F.coalesce(own, F.lit(0)).cast("long")
    return numbered.select(
        "doc_id", "size", "source_size", "target", (own * F.col("size")).alias("taken"), own.alias("copies"), F.coalesce("rate", F.lit(0.0)).alias("rate"), "row"
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    row, times = free_name(docs, "row"), free_name(docs, "times")
    copies = mix(docs).where("copies > 0").select(F.col("row").alias(row), F.col("copies").cast("int").alias(times))
    taken = docs.withColumn(row, F.monotonically_increasing_id()).join(copies, row)
    return taken.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*map(quoted, docs.columns))


def op8_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("row")
