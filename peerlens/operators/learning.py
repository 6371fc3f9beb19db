"""Walk-forward estimation for all dates at once.

Linear fits come from per-date moments: one distributed pass sums the moments of every date; growing training sets are prefix
sums over that calendar-sized table, so each row of the panel is read once whatever the number of refits. Only
the small normal equations are solved in Python.

Logistic fits take Newton steps for all dates together: a step is one pass over the rows, in which every task sums
gradient and Hessian of each fit whose training set holds its rows; what reaches the driver is one small matrix a fit.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import durable, held
from .ranking import _slice_number


def _moment_names(p: int) -> tuple[list[str], list[str], list[str]]:
    sx = [f"sx_{i}" for i in range(p)]
    sxy = [f"sxy_{i}" for i in range(p)]
    sxx = [f"sxx_{i}_{j}" for i in range(p) for j in range(i, p)]
    return sx, sxy, sxx


def date_moments(df: DataFrame, features: Sequence[str], label: str, train: Column | None = None) -> DataFrame:
    """(date, n, sy, sums, products): missing features count as zero, rows without a label not at all."""
    use = F.col(label).isNotNull() if train is None else F.col(label).isNotNull() & train
    x = [F.when(use, F.coalesce(F.col(f).cast("double"), F.lit(0.0))) for f in features]
    y = F.when(use, F.col(label))
    p = len(features)
    sx, sxy, sxx = _moment_names(p)
    aggs = [F.count(y).alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy")]
    aggs += [F.sum(x[i]).alias(sx[i]) for i in range(p)]
    aggs += [F.sum(x[i] * y).alias(sxy[i]) for i in range(p)]
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    aggs += [F.sum(x[i] * x[j]).alias(n) for (i, j), n in zip(pairs, sxx)]
    sums = df.groupBy("date").agg(*aggs)
    filled = [F.coalesce(c, F.lit(0.0)).alias(c) for c in sums.columns if c not in ("date", "n")]
    return sums.select("date", "n", *filled)


def training_moments(moments: DataFrame, features: Sequence[str], embargo_months: int = 0) -> DataFrame:
    """Moments of all dates strictly before each date (or ended ``embargo_months`` earlier)."""
    names = [c for c in moments.columns if c != "date"]
    order = Window.orderBy("date")
    if embargo_months == 0:
        w = order.rowsBetween(Window.unboundedPreceding, -1)
        sums = [F.coalesce(F.sum(c).over(w), F.lit(0.0)).alias(c) for c in names]
        return moments.select("date", (F.row_number().over(order) - 1).alias("n_prior"), *sums)
    dates = moments.select("date", (F.row_number().over(order) - 1).alias("n_prior"))
    past = moments.withColumnRenamed("date", "__s")
    j = dates.join(F.broadcast(past), F.col("__s") <= F.add_months("date", -embargo_months), "left")
    return j.groupBy("date", "n_prior").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in names])


def solve_ridge(n: float, sy: float, sx: np.ndarray, sxy: np.ndarray, upper: np.ndarray, alpha: float):
    """Intercept and slopes of |y - b - Xw|^2 + alpha |w|^2 from sums."""
    p = len(sx)
    gram = np.zeros((p, p))
    gram[np.triu_indices(p)] = upper
    gram = gram + np.triu(gram, 1).T
    mean_x, mean_y = sx / n, sy / n
    a = gram - n * np.outer(mean_x, mean_x) + alpha * np.eye(p)
    w = np.linalg.solve(a, sxy - n * mean_x * mean_y)
    return mean_y - float(w @ mean_x), w


def ridge_coefficients(
    train: DataFrame, features: Sequence[str], alpha: float = 10.0, min_prior: int = 6, min_rows: int = 50
) -> DataFrame:
    """(date, intercept, coef array) for every date with enough history."""
    p = len(features)
    sx, sxy, sxx = _moment_names(p)
    packed = train.where((F.col("n_prior") >= min_prior) & (F.col("n") >= min_rows)).select(
        "date", F.col("n").cast("double").alias("n"), "sy", F.array(*sx).alias("sx"), F.array(*sxy).alias("sxy"),
        F.array(*sxx).alias("sxx"),
    )

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                b, w = solve_ridge(r.n, r.sy, np.array(r.sx), np.array(r.sxy), np.array(r.sxx), alpha)
                rows.append((r.date, b, w.tolist()))
            yield pd.DataFrame(rows, columns=["date", "intercept", "coef"])

    return packed.mapInPandas(solve, "date date, intercept double, coef array<double>")


def predict(df: DataFrame, coefs: DataFrame, features: Sequence[str], out: str) -> DataFrame:
    """Negated linear prediction, so that a higher score expects a lower return."""
    j = df.join(F.broadcast(coefs), "date", "left")  # one row per date
    total = F.col("intercept")
    for i, f in enumerate(features):
        total = total + F.col("coef")[i] * F.coalesce(F.col(f).cast("double"), F.lit(0.0))
    return j.withColumn(out, -total).drop("intercept", "coef")


def walk_forward(
    df: DataFrame, features: Sequence[str], label: str, selection: Column | None = None, alpha: float = 10.0,
    min_prior: int = 6, min_rows: int = 50, embargo_months: int = 0, out: str = "score_ml",
) -> tuple[DataFrame, DataFrame]:
    """Out-of-sample ridge score per date and the tidy coefficient history."""
    m = date_moments(df, features, label, selection)
    coefs = held(ridge_coefficients(training_moments(m, features, embargo_months), features, alpha, min_prior, min_rows))  # one row per date
    scored = predict(df, coefs, features, out)
    names = F.array(*[F.lit(f.removesuffix("__n")) for f in features])
    history = coefs.select("date", F.explode(F.arrays_zip(names.alias("feature"), F.col("coef"))).alias("c")).select(
        "date", F.col("c")["feature"].alias("feature"), F.col("c")["coef"].alias("coef")
    )
    return scored, history


def in_sample(
    df: DataFrame, features: Sequence[str], label: str, selection: Column | None = None, alpha: float = 10.0,
    min_rows: int = 100, out: str = "is_score",
) -> DataFrame:
    """One ridge on the whole history, scored on the same rows: the overfit ceiling."""
    m = date_moments(df, features, label, selection)
    total = m.groupBy(F.lit(None).cast("date").alias("date")).agg(
        F.lit(1_000_000).alias("n_prior"), *[F.sum(c).alias(c) for c in m.columns if c != "date"]
    )
    coef = ridge_coefficients(total, features, alpha, 0, min_rows).select("intercept", "coef")
    j = df.join(F.broadcast(coef), F.lit(True))
    pred = F.col("intercept")
    for i, f in enumerate(features):
        pred = pred + F.col("coef")[i] * F.coalesce(F.col(f).cast("double"), F.lit(0.0))
    return j.withColumn(out, -pred).drop("intercept", "coef")


def growing_quantile(train: DataFrame, fits: DataFrame, value: str, prob: float, grid: int = 256) -> DataFrame:
    """(fit, n, cut): exact linear quantile of ``value`` over all rows dated before each fit date.

    ``train``: (date, value), no nulls, written; ``fits``: one row per fit date. A sketch cuts the values into ``grid``
    buckets; their counts by date tell each fit the buckets of its quantile, and only the distinct values of those
    are looked at again. So the work is one pass, and no task holds a history."""
    steps = F.array(*[F.lit(i / grid) for i in range(1, grid)])
    edges = train.agg(F.array_distinct(F.approx_percentile(value, steps)).alias("__e"))  # one row
    placed = train.select("date", F.col(value).cast("double").alias("__v")).join(F.broadcast(edges), F.lit(True))
    levels = durable(placed.groupBy("date", _slice_number(F.col("__v"), F.col("__e")).alias("__b"), "__v").agg(F.count(F.lit(1)).alias("__c")))
    known = F.broadcast(fits.select(F.col("date").alias("fit")))  # one row per date
    by_bucket = levels.groupBy("date", "__b").agg(F.sum("__c").alias("__c")).join(known, F.col("date") < F.col("fit"))
    held = by_bucket.groupBy("fit", "__b").agg(F.sum("__c").alias("__c"))
    w = Window.partitionBy("fit")  # one row per bucket
    told = held.withColumn("__upto", F.sum("__c").over(w.orderBy("__b"))).withColumn("n", F.sum("__c").over(w))
    pos = (F.col("n") - 1) * F.lit(float(prob))
    told = told.withColumn("__lo", F.floor(pos) + 1).withColumn("__hi", F.ceil(pos) + 1).withColumn("__frac", pos - F.floor(pos))
    before = F.col("__upto") - F.col("__c")
    wanted = told.where((before < F.col("__hi")) & (F.col("__upto") >= F.col("__lo"))).select("fit", "__b", before.alias("__before"), "n", "__lo", "__hi", "__frac")
    near = levels.join(F.broadcast(wanted), "__b").where(F.col("date") < F.col("fit"))  # a bucket or two per fit
    near = near.groupBy("fit", "__b", "__v", "__before", "n", "__lo", "__hi", "__frac").agg(F.sum("__c").alias("__c"))
    upto = F.col("__before") + F.sum("__c").over(Window.partitionBy("fit", "__b").orderBy("__v"))
    near = near.withColumn("__upto", upto)
    first = lambda r: F.min(F.when(F.col("__upto") >= F.col(r), F.col("__v")))
    got = near.groupBy("fit", "n", "__frac").agg(first("__lo").alias("__x"), first("__hi").alias("__y"))
    return got.select("fit", "n", (F.col("__x") + (F.col("__y") - F.col("__x")) * F.col("__frac")).alias("cut"))


EPOCH = dt.date(1970, 1, 1)


def _logistic_sums(batches: Iterator[pa.RecordBatch], fits: list[tuple[int, float, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """(fit, place, value): loss, gradient and upper Hessian of each fit over the rows of a task."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        days = b.column("day").to_numpy(zero_copy_only=False)
        y = b.column("y").to_numpy(zero_copy_only=False)
        x = np.array(b.column("x").flatten().to_numpy(zero_copy_only=False)).reshape(b.num_rows, -1)
        x = np.hstack([np.ones((b.num_rows, 1)), x])
        upper = np.triu_indices(x.shape[1])
        for i, (day, cut, w) in enumerate(fits):
            use = days < day
            if not use.any():
                continue
            xs, t = x[use], (y[use] <= cut).astype(float)
            z = xs @ w
            p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            hess = (xs * (p * (1 - p))[:, None]).T @ xs
            got = np.concatenate([[(np.logaddexp(0, z) - t * z).sum()], xs.T @ (p - t), hess[upper]])
            sums[i] = sums.get(i, 0) + got
    for i, v in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([i] * len(v), pa.int32()), pa.array(range(len(v)), pa.int32()), pa.array(v, pa.float64())], ["fit", "place", "value"])


def logistic_coefficients(
    df: DataFrame, features: Sequence[str], label: str, selection: Column | None = None, min_prior: int = 6, min_rows: int = 50,
    share: float = 0.25, penalty: float = 1.0, max_steps: int = 50, tolerance: float = 1e-9,
) -> DataFrame:
    """(date, intercept, coef) of P(label in the lowest ``share`` of the training rows) for every date with enough history.

    L2 penalty on the slopes, none on the intercept. A step that raises a fit's loss is halved. Dates whose training rows are
    of one class have no row. The driver holds one row of numbers per date."""
    spark, p = df.sparkSession, len(features)
    use = F.col(label).isNotNull() if selection is None else F.col(label).isNotNull() & selection
    filled = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    rows = durable(df.select("date", F.col(label).cast("double").alias("y"), filled.alias("x"), use.alias("__use")))
    dates = rows.select("date").distinct().where(F.col("date").isNotNull())
    fits = durable(dates.withColumn("__prior", F.row_number().over(Window.orderBy("date")) - 1).where(F.col("__prior") >= min_prior))
    train = rows.where("__use")
    cuts = growing_quantile(train.select("date", "y"), fits, "y", share).where(F.col("n") >= min_rows)
    chosen = sorted((r["fit"], r["cut"]) for r in cuts.collect())  # one row per date
    numbered = train.select(F.unix_date("date").alias("day"), "y", "x")
    weights = [np.zeros(p + 1) for _ in chosen]
    last = [(np.inf, w) for w in weights]
    ridge = np.diag([0.0] + [penalty] * p)
    upper = np.triu_indices(p + 1)
    going = set(range(len(chosen)))
    for _ in range(max_steps):
        if not going:
            break
        now = sorted(going)
        state = [((chosen[i][0] - EPOCH).days, chosen[i][1], weights[i]) for i in now]
        parts = numbered.mapInArrow(partial(_logistic_sums, fits=state), "fit int, place int, value double")
        sums = np.zeros((len(now), 1 + (p + 1) + len(upper[0])))
        for r in parts.groupBy("fit", "place").agg(F.sum("value").alias("value")).collect():  # one small matrix a fit
            sums[r["fit"], r["place"]] = r["value"]
        for i, v in zip(now, sums):
            w = weights[i]
            loss, grad = v[0] + 0.5 * w @ ridge @ w, v[1 : p + 2] + ridge @ w
            if loss > last[i][0] + 1e-9 * abs(last[i][0]):
                weights[i] = (w + last[i][1]) / 2
                continue
            hess = np.zeros((p + 1, p + 1))
            hess[upper] = v[p + 2 :]
            hess = hess + np.triu(hess, 1).T + ridge
            step = np.linalg.lstsq(hess, grad, rcond=None)[0]
            last[i] = (loss, w)
            weights[i] = w - step
            if np.abs(step).max() <= tolerance * (1 + np.abs(w).max()):
                going.discard(i)
    kind = "date date, intercept double, coef array<double>"
    found = [(d, float(w[0]), [float(x) for x in w[1:]]) for (d, _), w in zip(chosen, weights)]
    return spark.createDataFrame(found, kind)


def walk_forward_logistic(
    df: DataFrame, features: Sequence[str], label: str, selection: Column | None = None, out: str = "score_ml", **more
) -> DataFrame:
    """``df`` with the probability of a bad outcome from the fit of each date; NULL on dates without a fit.

    The score is not negated: it already is larger for worse."""
    coefs = logistic_coefficients(df, features, label, selection, **more)
    scored = predict(df, coefs, features, "__z")
    return scored.withColumn(out, 1 / (1 + F.exp(F.col("__z")))).drop("__z")  # predict negates


def walk_forward_variant(
    df: DataFrame, features: Sequence[str], label: str, kind: str, refit_dates: Sequence, selection: Column | None = None,
    min_rows: int = 50, trees: int = 200, seed: int = 7, out: str = "score_ml",
) -> DataFrame:
    """Logistic (bottom-quartile) or boosted-tree variant, refitted for each given date with
    Spark's own learners. The logistic score is P(bad): it is not negated, so larger stays worse.

    Every row is returned: the score is NULL on dates that are not refitted, have too few training
    rows, or (logistic) training rows of one class only."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import GBTRegressor

    use = F.lit(True) if selection is None else selection
    filled = df.select("*", *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"__{f}") for f in features])
    data = VectorAssembler(inputCols=[f"__{f}" for f in features], outputCol="__x").transform(filled)
    data = data.drop(*[f"__{f}" for f in features])
    parts, fitted = [], []
    for day in refit_dates:
        d = F.lit(day).cast("date")
        train = data.where((F.col("date") < d) & F.col(label).isNotNull() & use)
        n = train.count()
        if n < min_rows:
            continue
        test = data.where(F.col("date") == d)
        if kind == "logistic":
            cut = train.agg(F.percentile(label, F.lit(0.25)).alias("__cut"))
            train = train.join(F.broadcast(cut), F.lit(True)).withColumn("__y", (F.col(label) <= F.col("__cut")).cast("double"))
            if train.select("__y").distinct().count() < 2:
                continue
            model = LogisticRegression(featuresCol="__x", labelCol="__y", maxIter=500, regParam=1.0 / n, standardization=False).fit(train)
            scored = model.transform(test).withColumn(out, vector_to_array("probability")[1])
        elif kind == "gbm":
            model = GBTRegressor(
                featuresCol="__x", labelCol=label, maxIter=trees, maxDepth=3, stepSize=0.03, subsamplingRate=0.8, seed=seed
            ).fit(train)
            scored = model.transform(test).withColumn(out, -F.col("prediction"))
        else:
            raise ValueError(f"unknown variant {kind!r}")
        parts.append(scored.select(*df.columns, out))
        fitted.append(d)
    rest = df.withColumn(out, F.lit(None).cast("double"))
    result = rest.where(F.col("date").isNull() | ~F.col("date").isin(*fitted)) if fitted else rest
    for p in parts:
        result = result.unionByName(p)
    return result
