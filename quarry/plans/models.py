"""Walk-forward models on pyspark.ml: choose on validation, test once."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import stats
from quarry.operators import order
from quarry.operators.qc import without_all_null
from quarry.plans.spec import Window


@dataclass(frozen=True)
class Model:
    """A kind of model by name; classification models give a probability."""

    name: str
    make: Callable[[int], Any]
    task: str = "classification"


def _logistic(n: int) -> Any:
    # a penalty of C = 1 on the sum of losses is 1 / n on their mean
    return LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=1.0 / max(1, n), maxIter=50)


MODELS = {
    m.name: m
    for m in (
        Model("logistic", _logistic),
        Model("random_forest", lambda n: RandomForestClassifier(featuresCol="x", labelCol="y", weightCol="w", numTrees=100, maxDepth=5, seed=42)),
        Model("linear", lambda n: LinearRegression(featuresCol="x", labelCol="y"), "regression"),
        Model("random_forest_regression", lambda n: RandomForestRegressor(featuresCol="x", labelCol="y", numTrees=100, maxDepth=5, seed=42), "regression"),
    )
}


def balanced(df: DataFrame) -> DataFrame:
    """Weights that give both classes the same mass."""
    n, p = df.agg(F.count(F.lit(1)), F.count_if(F.col("y") > 0)).first()
    up, down = n / (2 * p) if p else 1.0, n / (2 * (n - p)) if n - p else 1.0
    return df.withColumn("w", F.when(F.col("y") > 0, F.lit(up)).otherwise(F.lit(down)))


def fit(train: DataFrame, features: Sequence[str], model: Model) -> PipelineModel:
    """Median imputation, scaling and the model, on rows with a label."""
    rows = train.where(F.col("y").isNotNull()).select("y", *[F.col(c).cast("double").alias(c) for c in features])
    rows = balanced(rows) if model.task == "classification" else rows.withColumn("w", F.lit(1.0))
    names = list(features)
    stages = [Imputer(strategy="median", inputCols=names, outputCols=[f"i_{c}" for c in names]), VectorAssembler(inputCols=[f"i_{c}" for c in names], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True), model.make(rows.count())]
    return Pipeline(stages=stages).fit(rows)


def predict(fitted: PipelineModel, rows: DataFrame, features: Sequence[str], model: Model) -> DataFrame:
    """rows with score: the probability of 1, or the predicted number."""
    out = fitted.transform(rows.withColumns({c: F.col(c).cast("double") for c in features}))
    score = vector_to_array("probability")[1] if model.task == "classification" else F.col("prediction")
    return out.select(*rows.columns, score.alias("score"))


def metrics(scored: DataFrame) -> dict[str, float | int | None]:
    """n, AUC, log-loss and Brier score."""
    rows = scored.where(F.col("y").isNotNull())
    n, ll, b = rows.agg(F.count(F.lit(1)), stats.log_loss(F.col("y"), F.col("score"), 1e-6), stats.brier(F.col("y"), F.col("score"))).first()
    return {"n": n, "auc": order.auc(rows, "y", "score").first()["auc"], "log_loss": ll, "brier": b}


def walk_forward(panel: DataFrame, features: Sequence[str], windows: Sequence[Window], models: Sequence[Model], date: str = "snapshot_date", least: int = 100) -> list[dict[str, Any]]:
    """Per window the model with the best validation AUC and its metrics on the test, which is used
    once. Windows with fewer than `least` rows or one class in validation or test are skipped."""
    out = []
    for w in windows:
        rows = panel.withColumn("split", w.split(F.col(date))).where("split is not null and y is not null").persist()
        try:
            shape = {r["split"]: r for r in rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("y").alias("classes")).collect()}
            if any(s not in shape or shape[s]["n"] < least or shape[s]["classes"] < 2 for s in ("train", "validation", "test")):
                out.append({"window": w.name, "status": "skipped"})
                continue
            part = lambda s: rows.where(F.col("split") == s)  # noqa: B023, E731
            names = without_all_null(part("train"), list(features))
            fitted = {m.name: (m, fit(part("train"), names, m)) for m in models}
            auc = {k: metrics(predict(f, part("validation"), names, m))["auc"] or 0.0 for k, (m, f) in fitted.items()}
            best = max(sorted(auc), key=lambda k: auc[k])
            m, f = fitted[best]
            out.append({"window": w.name, "status": "ok", "model": best, "validation_auc": auc[best], "features": len(names), **metrics(predict(f, part("test"), names, m))})
        finally:
            rows.unpersist()
    return out


def incremental(panel: DataFrame, base: Sequence[str], added: Sequence[str], windows: Sequence[Window], date: str = "snapshot_date") -> list[dict[str, Any]]:
    """Base features, with the added ones, and with their products with the first base feature: metrics
    on the test and their distance from the base."""
    products = {f"{base[0]}__x__{a}": F.col(base[0]) * F.col(a) for a in added}
    rows = panel.withColumns(products)
    families = {"base": list(base), "plus": [*base, *added], "product": [*base, *added, *products]}
    out = []
    for w in windows:
        split = rows.withColumn("split", w.split(F.col(date)))
        columns = sorted({c for f in families.values() for c in f})
        split = split.where("split is not null").select("split", "y", *columns).persist()
        before, test = split.where("split in ('train', 'validation')"), split.where("split = 'test'")
        first = None
        for name, features in families.items():
            m = MODELS["logistic"]
            got = metrics(predict(fit(before, features, m), test, features, m))
            first = first or got
            delta = {f"delta_{k}": got[k] - first[k] if got[k] is not None and first[k] is not None else None for k in ("auc", "log_loss", "brier")}
            out.append({"window": w.name, "family": name, **got, **delta})
        split.unpersist()
    return out


def select_features(panel: DataFrame, sets: dict[str, Sequence[str]], windows: Sequence[Window], model: str = "logistic", date: str = "snapshot_date") -> list[dict[str, Any]]:
    """Per window the feature set with the best validation AUC, refitted on all that is before the test, and
    its metrics on the test. Ties go to the set named first."""
    out = []
    m = MODELS[model]
    for w in windows:
        rows = panel.withColumn("split", w.split(F.col(date))).where("split is not null and y is not null").persist()
        try:
            part = lambda *s: rows.where(F.col("split").isin(*s))  # noqa: B023, E731
            jobs = [lambda f=list(f): metrics(predict(fit(part("train"), f, m), part("validation"), f, m))["auc"] or 0.0 for f in sets.values()]
            auc = dict(zip(sets, in_parallel(jobs), strict=True))
            best = max(sets, key=lambda k: auc[k])
            chosen = list(sets[best])
            got = metrics(predict(fit(part("train", "validation"), chosen, m), part("test"), chosen, m))
            out.append({"window": w.name, "chosen": best, "validation_auc": auc[best], **{f"test_{k}": v for k, v in got.items()}})
        finally:
            rows.unpersist()
    return out


def importance(panel: DataFrame, features: Sequence[str], window: Window, date: str = "snapshot_date") -> list[tuple[str, float]]:
    """How much each feature contributes to a random forest fitted before the test, the most first."""
    rows = panel.withColumn("split", window.split(F.col(date))).where("split in ('train', 'validation') and y is not null")
    forest = fit(rows, list(features), MODELS["random_forest"]).stages[-1]
    return sorted(zip(features, (float(v) for v in forest.featureImportances.toArray()), strict=True), key=lambda t: (-t[1], t[0]))


def controlled(panel: DataFrame, event_features: Sequence[str], controls: Sequence[str], windows: Sequence[Window], date: str = "snapshot_date") -> list[dict[str, Any]]:
    """An event score from its own features, then a model of it with the controls: standardised
    coefficients on what is before the test, and the test's AUC with and without the controls."""
    m, out = MODELS["logistic"], []
    for w in windows:
        rows = panel.withColumn("split", w.split(F.col(date))).where("split is not null and y is not null")
        before = rows.where("split in ('train', 'validation')")
        event = fit(before, event_features, m)
        scored = predict(event, rows, event_features, m).withColumnRenamed("score", "event_score").persist()
        try:
            names = ["event_score", *controls]
            both = fit(scored.where("split <> 'test'"), names, m)
            test = scored.where("split = 'test'")
            weights = dict(zip(names, (float(v) for v in both.stages[-1].coefficients), strict=True))
            plain = order.auc(test, "y", "event_score").first()["auc"]
            out.append({"window": w.name, **{f"weight_{k}": v for k, v in weights.items()}, "auc_event": plain, "auc": metrics(predict(both, test, names, m))["auc"]})
        finally:
            scored.unpersist()
    return out


def out_of_sample(panel: DataFrame, features: Sequence[str], windows: Sequence[Window], model: str = "logistic", date: str = "snapshot_date") -> DataFrame:
    """Scores of every window's test by a model fitted on what is before it, with the window's name."""
    m, out = MODELS[model], None
    for w in windows:
        rows = panel.withColumn("split", w.split(F.col(date)))
        fitted = fit(rows.where("split in ('train', 'validation') and y is not null"), list(features), m)
        scored = predict(fitted, rows.where("split = 'test'"), list(features), m).withColumn("window", F.lit(w.name))
        out = scored if out is None else out.unionByName(scored)
    return out


def in_parallel(jobs: Sequence[Callable[[], Any]], at_once: int = 4) -> list[Any]:
    """Independent experiments from a few driver threads; the scheduler shares the cluster between them."""
    with ThreadPoolExecutor(at_once) as pool:
        return [f.result() for f in [pool.submit(j) for j in jobs]]
