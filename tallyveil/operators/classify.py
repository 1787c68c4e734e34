"""Classifiers trained on synthetic tables and scored on real ones."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.ml import classification as ML
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyveil.functions.sqltext import ident
from tallyveil.operators.regression import TASK_ROWS
from tallyveil.operators.trainers import TRAINERS
from tallyveil.session import cut_lineage

PARALLEL_FITS = 4
MAJORITY = "majority"

Factory = Callable[[int], object]

# Sizes and step counts of the compared models.
MODELS: dict[str, Factory | None] = {
    MAJORITY: None,
    "gradient_boosting": lambda d: ML.GBTClassifier(maxIter=100, maxDepth=3, stepSize=0.1, seed=1),
    "random_forest": lambda d: ML.RandomForestClassifier(numTrees=100, maxDepth=10, seed=1),
    "linear_svc": lambda d: ML.LinearSVC(maxIter=1000, regParam=0.0001, tol=1e-4),
    "neural_net": lambda d: ML.MultilayerPerceptronClassifier(layers=[d, 100, 2], maxIter=200, seed=1),
}
_WEIGHTED = (ML.GBTClassifier, ML.LinearSVC)  # exact on compressed, weighted rows


def confusion(predicted: DataFrame, keys: Sequence[str], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(keys..., tp, tn, fp, fn) in one aggregation."""
    y, p = F.col(label).cast("int"), F.col(prediction).cast("int")
    hit = lambda a, b: F.sum(((y == a) & (p == b)).cast("long"))
    return predicted.groupBy(*keys).agg(hit(1, 1).alias("tp"), hit(0, 0).alias("tn"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"))


def metrics(predicted: DataFrame, keys: Sequence[str], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(keys..., accuracy, balanced_accuracy, f1). Recall of a class without rows is skipped; f1 is 0 when undefined."""
    return metrics_of(confusion(predicted, keys, label, prediction), keys)


def metrics_of(counted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The metrics from counts tp, tn, fp, fn."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    recall1 = F.when(tp + fn > 0, tp / F.nullif(tp + fn, F.lit(0)))
    recall0 = F.when(tn + fp > 0, tn / F.nullif(tn + fp, F.lit(0)))
    balanced = F.when(recall1.isNull(), recall0).when(recall0.isNull(), recall1).otherwise((recall1 + recall0) / 2)
    f1 = F.coalesce(2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0)), F.lit(0.0))
    return counted.select(
        *keys, ((tp + tn) / (tp + tn + fp + fn)).alias("accuracy"), balanced.alias("balanced_accuracy"), f1.alias("f1"))


def majority_label(train: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Most frequent label per table; the smaller label on a tie."""
    counts = train.groupBy(*keys, F.col(label).cast("int").alias("prediction")).agg(F.count("*").alias("n"))
    best = F.max_by("prediction", F.struct(F.col("n"), -F.col("prediction")))
    return counts.groupBy(*keys).agg(best.alias("prediction"))


def two_class_tables(train: DataFrame, table_key: str, label: str) -> DataFrame:
    """Keep only tables in which both classes occur."""
    both = train.groupBy(table_key).agg(F.min(label).alias("__a"), F.max(label).alias("__b")).filter("__a <> __b").select(table_key)
    return train.join(both, table_key, "left_semi")


def fit_predict(name: str, factory: Factory | None, train: DataFrame, test: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Test rows (label, prediction) under one model."""
    if factory is None:
        best = majority_label(train, label)
        return test.select(F.col(label).alias("label")).join(F.broadcast(best))
    gather = VectorAssembler(inputCols=list(features), outputCol="__x")
    shape = lambda df: df.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias("label"))
    model = factory(len(features)).setFeaturesCol("__x").setLabelCol("label")
    rows = shape(train)
    if isinstance(model, _WEIGHTED):
        rows = rows.groupBy(*features, "label").agg(F.count("*").cast("double").alias("__w"))
        model = model.setWeightCol("__w")
    fitted = model.fit(gather.transform(rows))
    return fitted.transform(gather.transform(shape(test))).select(F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"))


def train_and_score(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, table_key: str | None = None,
                    models: Mapping[str, Factory | None] = MODELS, tables: Sequence | None = None) -> DataFrame:
    """All models on each synthetic table and on all stacked (null table), scored on the test table.

    Rows: (table, model, accuracy, balanced_accuracy, f1). Tables with a single class give no row. Fits are
    Spark jobs started from a few driver threads; `tables` lists the table keys when they are known.
    """
    if table_key is not None:
        train = two_class_tables(train, table_key, label)
    elif train.agg(F.countDistinct(label)).first()[0] < 2:
        return test.sparkSession.createDataFrame([], "table_id int, model string, accuracy double, balanced_accuracy double, f1 double")
    train, test = train.persist(), test.persist()
    ids: list = [None]
    if table_key is not None:
        ids += sorted(r[0] for r in train.select(table_key).distinct().collect()) if tables is None else list(tables)
    kind = "int" if table_key is None else train.select(table_key).schema[0].dataType.simpleString()
    jobs = [(t, name, make) for t in ids for name, make in models.items()]

    def run(job):
        t, name, make = job
        part = train if t is None else train.filter(F.col(table_key) == t)
        scored = fit_predict(name, make, part, test, features, label)
        return scored.select(F.lit(t).cast(kind).alias("table_id"), F.lit(name).alias("model"), "label", "prediction")

    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        parts = list(pool.map(run, jobs))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return metrics(out, ["table_id", "model"])


def distinct_rows(df: DataFrame, keys: Sequence[str], features: Sequence[str], label: str, rows: str | None = None) -> DataFrame:
    """Distinct (keys, features, label) with their number; partial counts come before the shuffle."""
    number = F.sum(F.col(rows).cast("double")) if rows else F.count("*").cast("double")
    shaped = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("int").alias("label"), *([rows] if rows else []))
    return shaped.groupBy(*keys, *features, "label").agg(number.alias("__w"))


def train_all(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, table_key: str | None = None,
              models: Sequence[str] = tuple(TRAINERS), rows: str | None = None, test_rows: str | None = None,
              task_rows: int = TASK_ROWS) -> DataFrame:
    """All models on each table and on all tables stacked (null key), scored on the test table, in one plan.

    Rows: (table_key or table_id, model, accuracy, balanced_accuracy, f1). Training tables and the test table are counted to
    distinct weighted rows first; each (table, model) is then fitted and scored in one task. Every table has to be small when
    counted, which is checked; beyond `task_rows` distinct rows `train_and_score` fits the models as Spark jobs instead.
    Tables with a single class give no row and do not join the stack. `rows` names the row numbers of counted tables.
    """
    out_key = table_key or "table_id"
    counted = distinct_rows(train, [table_key] if table_key else [], features, label, rows)
    if table_key:
        kind = train.select(table_key).schema[0].dataType.simpleString()
        counted = cut_lineage(two_class_tables(counted, table_key, "label"))
        whole = counted.groupBy(*features, "label").agg(F.sum("__w").alias("__w")).withColumn(table_key, F.lit(None).cast(kind))
        counted = cut_lineage(counted.unionByName(whole))
    else:
        kind = "int"
        counted = cut_lineage(counted.withColumn(out_key, F.lit(None).cast(kind)))
        if counted.select("label").distinct().count() < 2:
            counted = counted.limit(0)
    scored = distinct_rows(test, [], features, label, test_rows).limit(task_rows + 1).toPandas()
    largest = counted.groupBy(out_key).count().agg(F.max("count")).first()[0] or 0
    if max(largest, len(scored)) > task_rows:
        raise ValueError(f"more than {task_rows} distinct rows in a table; use train_and_score")
    shared = test.sparkSession.sparkContext.broadcast((scored[list(features)].to_numpy(float), scored["label"].to_numpy(int), scored["__w"].to_numpy(float)))

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        known, y, w = shared.value
        frame = frame.sort_values([*features, "label"])
        rule = TRAINERS[frame["model"].iloc[0]](frame[list(features)].to_numpy(float), frame["label"].to_numpy(float), frame["__w"].to_numpy(float))
        hit = rule(known)
        count = lambda a, b: int(round(w[(y == a) & (hit == b)].sum()))
        return pd.DataFrame({out_key: frame[out_key].iloc[:1].to_numpy(), "model": frame["model"].iloc[:1].to_numpy(), "tp": [count(1, 1)], "tn": [count(0, 0)], "fp": [count(0, 1)], "fn": [count(1, 0)]})

    jobs = counted.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    return metrics_of(jobs.groupBy(out_key, "model").applyInPandas(work, f"{ident(out_key)} {kind}, model string, tp long, tn long, fp long, fn long"), [out_key, "model"])
