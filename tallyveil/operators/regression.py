"""Regressions on one table or on many tables at once.

Rows are first compressed to distinct (table, features, outcome) with their weight. When every table
is then small, each is fitted by one task; otherwise all tables are fitted together by sums over the rows,
one pass per iteration, so no table ever has to fit in a task.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyveil.operators import slabs
from tallyveil.session import broadcast_checked, cut_lineage

TASK_ROWS = 200_000  # largest compressed table one task fits
MAX_ITER = 100
TOLERANCE = 1e-10
HELD_BYTES = 64 << 20  # sums of tables a task holds before it hands them on
POOLED = -1  # number of all tables stacked
FAN = 256  # parts a count of a resample is split into at a time
SEPARATED = 1e-8  # fitted probabilities this close to all outcomes mean perfect separation


def compress(df: DataFrame, group: Sequence[str], features: Sequence[str], label: str, weight: str | float = 1.0) -> DataFrame:
    """Distinct rows with their total weight: (group..., features..., y, w)."""
    w = F.sum(weight) if isinstance(weight, str) else F.count("*") * F.lit(float(weight))
    rows = df.select(*group, *[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias("y"),
                     *([F.col(weight).cast("double")] if isinstance(weight, str) else []))
    return rows.groupBy(*group, *features, "y").agg(w.alias("w"))


# ---------------------------------------------------------------- small tables: one task each


def _irls(x: np.ndarray, y: np.ndarray, w: np.ndarray, family: str, penalty: float):
    """Weighted Fisher scoring on few distinct rows; (estimates, variances) or None when separated."""
    d = x.shape[1]
    beta, last = np.zeros(d), np.inf
    if family == "poisson":
        eta = np.log(y + 0.5)
    else:
        eta = np.where(y > 0.5, 1.0, -1.0) * 0.5
    inv = None
    for _ in range(MAX_ITER):
        if family == "poisson":
            mu = np.exp(np.clip(eta, -500, 500))
            slope = mu
            dev = 2 * np.sum(w * (np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / mu), 0) - (y - mu)))
        else:
            mu = 1 / (1 + np.exp(-np.clip(eta, -500, 500)))
            if np.all(np.abs(mu - y) < SEPARATED):
                return None
            slope = np.maximum(mu * (1 - mu), 1e-300)
            dev = -2 * np.sum(w * (y * np.log(np.maximum(mu, 1e-300)) + (1 - y) * np.log(np.maximum(1 - mu, 1e-300))))
        done = abs(last - dev) <= TOLERANCE * (abs(dev) + 0.1)
        last = dev
        k = w * slope
        z = eta + (y - mu) / slope
        inv = np.linalg.pinv((x * k[:, None]).T @ x + penalty * np.eye(d), hermitian=True)
        beta = inv @ (x.T @ (k * z))
        eta = x @ beta
        if done:
            break
    return beta, np.diag(inv)


def _design(b: pd.DataFrame, features: Sequence[str], add_constant: bool) -> np.ndarray:
    x = b[list(features)].to_numpy(float)
    return np.column_stack([np.ones(len(b)), x]) if add_constant else x


def _out_schema(df: DataFrame, group: Sequence[str]) -> T.StructType:
    keys = [df.schema[g] for g in group]
    return T.StructType([*keys, T.StructField("param_index", T.IntegerType()), T.StructField("param", T.StringType()),
                         T.StructField("q", T.DoubleType()), T.StructField("u", T.DoubleType())])


def _fit_in_tasks(rows: DataFrame, group: Sequence[str], features: Sequence[str], add_constant: bool, family: str, ridge: float) -> DataFrame:
    names = (["const"] if add_constant else []) + list(features)

    def fit(b: pd.DataFrame) -> pd.DataFrame:
        # fixed row order: the same sums whichever order the shuffle delivered
        b = b.sort_values([*features, "y"])
        w = b["w"].to_numpy(float)
        found = _irls(_design(b, features, add_constant), b["y"].to_numpy(float), w, family, ridge * w.sum())
        q, u = found if found is not None else (np.full(len(names), np.nan), np.full(len(names), np.nan))
        out = pd.DataFrame({"param_index": np.arange(len(names), dtype=np.int32), "param": names, "q": q, "u": u})
        for g in reversed(group):
            out.insert(0, g, b[g].iloc[0])
        return out

    return rows.groupBy(*group).applyInPandas(fit, _out_schema(rows, group))


# ---------------------------------------------------------------- large tables: sums over all rows


def _beside(rows: DataFrame, side: DataFrame, key: Sequence[str]) -> DataFrame:
    """Join on the table key, where null is a key like any other."""
    named = side.select([F.col(c).alias(f"__side_{c}") if c in key else F.col(c) for c in side.columns])
    same = [F.col(k).eqNullSafe(F.col(f"__side_{k}")) for k in key]
    return rows.join(named, same).drop(*[f"__side_{k}" for k in key])


def _working(y: np.ndarray, eta: np.ndarray, w: np.ndarray, family: str):
    """Weights, weighted working outcomes, weighted deviance and distance to the outcome of rows at a linear predictor."""
    e = np.clip(eta, -500, 500)
    if family == "poisson":
        mu = np.exp(e)
        slope = mu
        dev = 2 * w * (np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / mu), 0) - (y - mu))
    else:
        mu = 1 / (1 + np.exp(-e))
        slope = np.maximum(mu * (1 - mu), 1e-300)
        dev = -2 * w * (y * np.log(np.maximum(mu, 1e-300)) + (1 - y) * np.log(np.maximum(1 - mu, 1e-300)))
    return w * slope, w * (slope * eta + (y - mu)), dev, np.abs(y - mu)


def _gram_sums(rows: DataFrame, features: Sequence[str], add_constant: bool, family: str, pooled: bool) -> DataFrame:
    """One pass: per table the slabs of (X'WX upper triangle, X'Wz, weight, deviance) and the largest distance to an outcome.

    Rows hold __g, features, y, w and __eta; with `pooled` they count a second time, at __all, for the table POOLED. A task holds
    the sums of the tables it has met, at most HELD_BYTES of them at a time.
    """
    d = len(features) + add_constant
    upper = np.triu_indices(d)
    size = len(upper[0]) + d + 2

    def emit(held: dict[int, np.ndarray], far: dict[int, float]) -> Iterator[pa.RecordBatch]:
        if held:
            which, part = slabs.pack_many(np.stack(list(held.values())))
            ids, gaps = np.fromiter(held, np.int64), np.array([far[g] for g in held])
            yield pa.RecordBatch.from_pydict({"__g": pa.array(ids[which]), **part, "far": pa.array(gaps[which])})

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, far = {}, {}
        for b in batches:
            column = {c: b.column(c).to_numpy(zero_copy_only=False) for c in b.schema.names}
            x = np.column_stack([np.ones(b.num_rows)] * add_constant + [column[c] for c in features])
            views = [(column["__g"], column["__eta"])] + ([(np.full(b.num_rows, POOLED), column["__all"])] if pooled else [])
            for tables, eta in views:
                k, kz, dev, gap = _working(column["y"], eta, column["w"], family)
                order = np.argsort(tables, kind="stable")
                cuts = np.flatnonzero(np.diff(tables[order])) + 1
                for at in np.split(order, cuts) if len(order) else []:
                    g, xs, xk = int(tables[at[0]]), x[at], x[at] * k[at, None]
                    sums = held.setdefault(g, np.zeros(size))
                    sums += np.concatenate([(xk.T @ xs)[upper], xs.T @ kz[at], [column["w"][at].sum(), dev[at].sum()]])
                    far[g] = max(far.get(g, 0.0), float(gap[at].max()))
            if len(held) * size * 8 > HELD_BYTES:
                yield from emit(held, far)
                held, far = {}, {}
        yield from emit(held, far)

    wanted = rows.select("__g", *features, "y", "w", "__eta", *(["__all"] if pooled else []))
    found = wanted.mapInArrow(partial, f"__g long, {slabs.schema('double')}, far double")
    return slabs.add_up(found, ["__g"], F.max("far").alias("far"))


def _solve(sums: DataFrame, groups: int, d: int, ridge: float) -> DataFrame:
    """Weighted least squares of every table from its slabs: (__g, beta = estimates then variances, dev, far).

    A task solves some tables together, as many as HELD_BYTES of sums allow.
    """
    upper = np.triu_indices(d)
    ends = np.cumsum([len(upper[0]), d, 1, 1])
    parts = int(sums.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(min(groups, parts), -(-groups * int(ends[-1]) * 8 // HELD_BYTES))

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        ids, place = np.unique(frame["__g"].to_numpy(), return_inverse=True)
        s = slabs.unpack_many(place, frame["slab"].to_numpy(), frame[slabs.VALUES].to_numpy(), len(ids), ends[-1])
        far = np.zeros(len(ids))
        np.maximum.at(far, place, frame["far"].to_numpy())
        a = np.zeros((len(ids), d, d))
        a[:, upper[0], upper[1]] = a[:, upper[1], upper[0]] = s[:, :ends[0]]
        a += ridge * s[:, ends[1], None, None] * np.eye(d)
        inv = np.linalg.pinv(a, hermitian=True)
        beta = np.concatenate([np.einsum("gij,gj->gi", inv, s[:, ends[0]:ends[1]]), np.diagonal(inv, axis1=1, axis2=2)], axis=1)
        return pd.DataFrame({"__g": ids, "beta": list(beta), "dev": s[:, ends[2]], "far": far})

    bucket = F.pmod(F.xxhash64("__g"), F.lit(buckets)).alias("__bucket")
    return sums.groupBy(bucket).applyInPandas(work, "__g long, beta array<double>, dev double, far double")


def _fit_by_sums(rows: DataFrame, group: Sequence[str], groups: int, features: Sequence[str], add_constant: bool, family: str, ridge: float,
                 pooled: bool = False) -> DataFrame:
    """All tables at once, one pass over the rows per step; `pooled` adds the fit of all rows, under a null key, in the same passes."""
    names = (["const"] if add_constant else []) + list(features)
    d = len(names)
    numbered = cut_lineage(rows.select(*group).distinct().withColumn("__g", F.monotonically_increasing_id()))

    def predictor(beta: Sequence[Column]) -> Column:
        return sum((b * (F.lit(1.0) if c == "const" and i == 0 and add_constant else F.col(c)) for i, (b, c) in enumerate(zip(beta, names))), F.lit(0.0))

    start = F.ln(F.col("y") + 0.5) if family == "poisson" else F.when(F.col("y") > 0.5, 0.5).otherwise(-0.5)
    state = None
    for _ in range(MAX_ITER + 1):
        if state is None:
            side, eta, whole = numbered, start, start
        else:
            side = numbered.join(broadcast_checked(state.select("__g", "beta"), groups + 1, 64 + 16 * d), "__g")
            eta = predictor([F.get("beta", F.lit(i)) for i in range(d)])
            if pooled:
                whole = predictor([F.lit(v) for v in state.filter(F.col("__g") == POOLED).first()["beta"][:d]])
        based = _beside(rows, broadcast_checked(side, max(groups, 1), 64 + 16 * d), group).withColumn("__eta", eta)
        if pooled:
            based = based.withColumn("__all", whole)
        new = _solve(_gram_sums(based, features, add_constant, family, pooled), max(groups, 1) + pooled, d, ridge)
        if state is None:
            state = cut_lineage(new.withColumn("last", F.lit(float("inf"))))
            continue
        old = state.select("__g", F.col("dev").alias("last"))
        state = cut_lineage(new.join(broadcast_checked(old, groups + 1, 64), "__g"))
        moves = F.abs(F.col("last") - F.col("dev")) > TOLERANCE * (F.abs("dev") + 0.1)
        if state.filter(moves & (F.lit(family == "poisson") | (F.col("far") >= SEPARATED))).isEmpty():
            break
    else:
        raise RuntimeError(f"the regression did not converge in {MAX_ITER} steps")
    ok = (F.col("far") >= SEPARATED) if family == "binomial" else F.lit(True)
    parts = F.explode(F.array(*[F.struct(F.lit(i).alias("param_index"), F.lit(n).alias("param"),
                                         F.when(ok, F.get("beta", F.lit(i))).alias("q"), F.when(ok, F.get("beta", F.lit(d + i))).alias("u")) for i, n in enumerate(names)]))
    keyed = state.join(broadcast_checked(numbered, max(groups, 1), 128), "__g", "left")  # no key: the pooled fit
    return keyed.select(*group, parts.alias("__p")).select(*group, "__p.*")


def fit_many(df: DataFrame, group: Sequence[str], features: Sequence[str], label: str, weight: str | float = 1.0,
             add_constant: bool = True, family: str = "binomial", ridge: float = 0.0, task_rows: int = TASK_ROWS) -> DataFrame:
    """Regression of every table: (group..., param_index, param, q, u), u = squared standard error.

    A perfectly separated table gets null estimates. A null in the key is a table of its own; rows with a null feature, label
    or weight are left out, whatever the size of the table.
    """
    if family not in ("binomial", "poisson"):
        raise ValueError(f"unknown family {family!r}")
    if not group:  # one table: the same code under a constant key
        one = fit_many(df.withColumn("__table", F.lit(0)), ["__table"], features, label, weight, add_constant, family, ridge, task_rows)
        return one.drop("__table")
    needed = [*features, label, *([weight] if isinstance(weight, str) else [])]
    rows = cut_lineage(compress(df.dropna(subset=needed), group, features, label, weight))
    size = rows.groupBy(*group).count().agg(F.max("count"), F.count("*")).first()
    if (size[0] or 0) <= task_rows:
        out = _fit_in_tasks(rows, group, features, add_constant, family, ridge)
    else:
        out = _fit_by_sums(rows, group, size[1], features, add_constant, family, ridge)
    none = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return out.select(*group, "param_index", "param", none("q"), none("u"))


class SeparationError(ValueError):
    """Outcomes are perfectly predicted, so estimates do not exist."""


def fit_one(df: DataFrame, features: Sequence[str], label: str, weight: str | float = 1.0, add_constant: bool = True,
            family: str = "binomial") -> DataFrame:
    """Regression of one table by the built-in generalised linear model on compressed rows: (param_index, param, q, u).

    Perfect separation raises.
    """
    rows = compress(df, [], features, label, weight).persist()
    # the built-in starting point overshoots under large weights, so they are scaled to at most 1
    scale = float(rows.agg(F.max("w")).first()[0])
    rows = rows.withColumn("w", F.col("w") / scale)
    ready = VectorAssembler(inputCols=list(features), outputCol="__x").transform(rows)
    model = GeneralizedLinearRegression(family=family, featuresCol="__x", labelCol="y", weightCol="w", fitIntercept=add_constant,
                                        maxIter=MAX_ITER, tol=1e-12).fit(ready)
    if family == "binomial":
        far = model.transform(ready).agg(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0]
        if far < 1e-4:
            raise SeparationError("outcomes are perfectly separated")
    coef, se = list(model.coefficients), list(model.summary.coefficientStandardErrors)
    if add_constant:  # the built-in summary lists the intercept last
        coef, se = [model.intercept, *coef], [se[-1], *se[:-1]]
    names = (["const"] if add_constant else []) + list(features)
    out = [(i, n, float(q), float(s) ** 2 / scale) for i, (n, q, s) in enumerate(zip(names, coef, se))]
    return df.sparkSession.createDataFrame(out, "param_index int, param string, q double, u double")


def fit_per_table_and_pooled(df: DataFrame, table_key: str, features: Sequence[str], label: str, weight: str | float = 1.0,
                             add_constant: bool = True, family: str = "binomial", ridge: float = 0.0, task_rows: int = TASK_ROWS) -> DataFrame:
    """Every table and all tables stacked (null table key), from one reading of the rows."""
    if family not in ("binomial", "poisson"):
        raise ValueError(f"unknown family {family!r}")
    needed = [*features, label, *([weight] if isinstance(weight, str) else [])]
    rows = cut_lineage(compress(df.dropna(subset=needed), [table_key], features, label, weight))
    size = rows.groupBy(table_key).count().agg(F.max("count"), F.count("*")).first()
    if (size[0] or 0) <= task_rows:
        each = _fit_in_tasks(rows, [table_key], features, add_constant, family, ridge)
        stacked = fit_many(rows, [], features, "y", "w", add_constant, family, ridge, task_rows)
        null_key = F.lit(None).cast(df.schema[table_key].dataType).alias(table_key)
        out = each.unionByName(stacked.select(null_key, "param_index", "param", "q", "u"))
    else:
        out = _fit_by_sums(rows, [table_key], size[1], features, add_constant, family, ridge, pooled=True)
    none = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return out.select(table_key, "param_index", "param", none("q"), none("u"))


def resample_counts(rows: DataFrame, group: Sequence[str], features: Sequence[str], samples: int, seed: int, part_rows: int = TASK_ROWS) -> DataFrame:
    """How often each compressed row is in each bootstrap resample of its table: (group..., features..., y, counts array<long>).

    The total of a table is split by multinomial draws down a tree: into parts of the rows, FAN at a time, until a part has
    about `part_rows` rows, and there into the rows. Splitting a multinomial count by the weights below it is again multinomial,
    so each resample has the law of as many rows drawn one by one, and every total is exact. Each split has a random source
    made from the seed, the table and its place, so a lost task draws the same numbers.
    """
    keys = [F.coalesce(F.concat(F.lit("="), F.col(g).cast("string")), F.lit("-")) for g in group]
    tagged = rows.withColumn("__tag", F.concat_ws("/", F.lit(""), *keys))
    largest = tagged.groupBy("__tag").count().agg(F.max("count")).first()[0] or 0
    parts, depth = max(1, -(-largest // part_rows)), 0
    while FAN ** depth < parts:
        depth += 1
    cells = tagged.withColumn("__part", F.pmod(F.xxhash64(*features, "y"), F.lit(parts).cast("long")))
    weights = cells.groupBy("__tag", "__part").agg(F.sum("w").alias("w"))
    if depth:
        weights = cut_lineage(weights)
    split = lambda level, order: _splitter(seed, level, order)
    counts = weights.groupBy("__tag").agg(F.lit(0).cast("long").alias("__part"),
                                          F.array_repeat(F.sum("w").cast("long"), samples).alias("counts"))
    for level in range(1, depth + 1):
        below = F.lit(FAN ** (depth - level)).cast("long")
        child = F.call_function("div", F.col("__part"), below)
        children = weights.groupBy("__tag", child.alias("__part")).agg(F.sum("w").alias("w"))
        ready = children.withColumn("__up", F.call_function("div", F.col("__part"), F.lit(FAN).cast("long")))
        both = ready.join(counts.withColumnRenamed("__part", "__up"), ["__tag", "__up"])
        counts = both.groupBy("__tag", "__up").applyInPandas(split(level, ["__part"]), "__tag string, __part long, counts array<long>")

    names, to_rows = [*group, *features, "y"], split(depth + 1, [*features, "y"])
    kinds = T.StructType([*[rows.schema[c] for c in names], T.StructField("counts", T.ArrayType(T.LongType()))])

    def leaf(some: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        if not len(some):
            return pd.DataFrame(columns=[*names, "counts"])
        some = some.assign(__up=some["__part"], counts=[given["counts"].iloc[0]] * len(some))
        return to_rows(some)[[*names, "counts"]]

    by = ["__tag", "__part"]
    return cells.groupBy(*by).cogroup(counts.groupBy(*by)).applyInPandas(leaf, kinds)


def _splitter(seed: int, level: int, order: Sequence[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Splits one count per resample (`counts`, equal in all rows) over rows by their weight `w`, in the order of some columns."""
    def split(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(list(order), ignore_index=True)
        source = np.random.default_rng([seed, level, int(frame["__up"].iloc[0]), *frame["__tag"].iloc[0].encode()])
        w = frame["w"].to_numpy(float)
        drawn = source.multinomial(np.asarray(frame["counts"].iloc[0], np.int64), w / w.sum())
        frame["counts"] = list(np.ascontiguousarray(drawn.T))
        return frame.drop(columns=["__up", "w"])

    return split


def fit_bootstrap(df: DataFrame, group: Sequence[str], features: Sequence[str], label: str, samples: int = 50,
                  ridge: float = 0.00001, level: float = 0.95, weight: float = 1.0, add_constant: bool = True, seed: int = 0,
                  task_rows: int = TASK_ROWS) -> DataFrame:
    """L2-penalised fits of bootstrap resamples: (group..., param_index, param, q, u, low, high).

    Resampling n rows is a multinomial draw over the compressed rows, seeded by table and sample number. Tables of up to
    `task_rows` distinct rows are drawn and fitted in one task per resample; beyond that the counts come from
    `resample_counts`, and all resamples are fitted together by sums over the rows.
    """
    rows = cut_lineage(compress(df.dropna(subset=[*features, label]), group, features, label))
    largest, tables = rows.groupBy(*group).count().agg(F.max("count"), F.count("*")).first()
    names = (["const"] if add_constant else []) + list(features)
    keys = [*group, "boot_id"]

    def resample(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values([*features, "y"])
        n = b["w"].to_numpy(float)
        tag = "/".join(str(b[k].iloc[0]) for k in keys)
        rng = np.random.default_rng([seed, *tag.encode()])
        w = rng.multinomial(int(n.sum()), n / n.sum()).astype(float) * weight
        hit = w > 0
        found = _irls(_design(b, features, add_constant)[hit], b["y"].to_numpy(float)[hit], w[hit], "binomial", ridge * w.sum())
        q = found[0] if found is not None else np.full(len(names), np.nan)
        out = pd.DataFrame({"param_index": np.arange(len(names), dtype=np.int32), "param": names, "q": q, "u": np.nan})
        for k in reversed(keys):
            out.insert(0, k, b[k].iloc[0])
        return out

    if (largest or 0) <= task_rows:
        many = rows.withColumn("boot_id", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
        fits = many.groupBy(*keys).applyInPandas(resample, _out_schema(many, keys)).filter(~F.isnan("q"))
    else:
        drawn = cut_lineage(resample_counts(rows, group, features, samples, seed))
        each = drawn.select(*group, *features, "y", F.posexplode("counts").alias("boot_id", "w")).filter("w > 0")
        fits = _fit_by_sums(each.withColumn("w", F.col("w") * F.lit(float(weight))), keys, tables * samples, features, add_constant,
                            "binomial", ridge).filter("q IS NOT NULL")
    tail = (1 - level) / 2
    return fits.groupBy(*group, "param_index", "param").agg(
        F.avg("q").alias("q"), F.var_pop("q").alias("u"), F.percentile("q", F.lit(tail)).alias("low"), F.percentile("q", F.lit(1 - tail)).alias("high"))


def normal_intervals(estimates: DataFrame, levels: Sequence[float]) -> DataFrame:
    """Each estimate with its normal interval at each level (`level`, `low`, `high`)."""
    table = F.explode(F.array(*[F.struct(F.lit(float(v)).alias("level"), F.lit(NormalDist().inv_cdf(0.5 + v / 2)).alias("z")) for v in levels]))
    wide = estimates.withColumn("__l", table)
    half = F.col("__l.z") * F.sqrt("u")
    return wide.select(*estimates.columns, F.col("__l.level").alias("level"), (F.col("q") - half).alias("low"), (F.col("q") + half).alias("high"))


def score(coefficients: dict[str, float], family: str = "binomial") -> tuple[Column, Column]:
    """Prediction and label (at 0.5, or rounded for counts) from fixed coefficients; `const` is the intercept."""
    eta = sum((F.lit(float(b)) if c == "const" else F.lit(float(b)) * F.col(c) for c, b in coefficients.items()), F.lit(0.0))
    if family == "poisson":
        mu = F.exp(eta)
        return mu, F.rint(mu)
    p = 1 / (1 + F.exp(-eta))
    return p, (p >= 0.5).cast("int")


def coefficients(estimates: DataFrame) -> dict[str, float]:
    """One fit's estimates on the driver."""
    return {r["param"]: r["q"] for r in estimates.orderBy("param_index").collect()}


def ols(df: DataFrame, features: Sequence[str], label: str, add_constant: bool = False) -> DataFrame:
    """Ordinary least squares: (param_index, param, q). Normal equations are summed on executors."""
    ready = VectorAssembler(inputCols=list(features), outputCol="__x").transform(df.select(*features, F.col(label).cast("double").alias("__y")))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        model = LinearRegression(featuresCol="__x", labelCol="__y", fitIntercept=add_constant, solver="normal").fit(ready)
    values = ([model.intercept] if add_constant else []) + list(model.coefficients)
    names = (["const"] if add_constant else []) + list(features)
    return df.sparkSession.createDataFrame([(i, n, float(v)) for i, (n, v) in enumerate(zip(names, values))], "param_index int, param string, q double")


def monomials(x: str, y: str, degree: int = 3) -> list[tuple[str, Column]]:
    """All products x^i y^j up to a degree, without the constant."""
    return [(f"{x}{i}_{y}{j}", F.pow(F.col(x), i) * F.pow(F.col(y), j)) for i in range(degree + 1) for j in range(degree + 1 - i) if i + j > 0]


def fit_polynomial(df: DataFrame, x: str, y: str, z: str, degree: int = 3) -> DataFrame:
    """Least-squares surface z ~ polynomial(x, y)."""
    terms = monomials(x, y, degree)
    return ols(df.select(*[c.alias(n) for n, c in terms], z), [n for n, _ in terms], z, add_constant=True)


def predict_polynomial(surface: dict[str, float], x: str, y: str, degree: int = 3) -> Column:
    return sum((F.lit(surface[n]) * c for n, c in monomials(x, y, degree)), F.lit(surface["const"]))
