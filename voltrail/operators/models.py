"""Energy-use models on Spark ML: pipelines, evaluation, the residual model, importances."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor, wait

from pyspark import inheritable_thread_target
from pyspark.errors import ArithmeticException, IllegalArgumentException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import ElementwiseProduct, OneHotEncoder, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltrail.operators import categories, metrics, selection
from voltrail.operators import rows as R
from voltrail.sources.stage import staged

RIDGE = 1.0
#: Candidates, those of few jobs first.
SOON, LATE = ("linear", "ridge", "forest"), ("boosted",)
#: Rows of a task of boosting, at least: its tasks are short, and fewer of them take no longer.
TASK_ROWS = 100_000


def regressors(train: DataFrame, target: str, trees: int = 50, depth: int = 8, leaf: int = 5, rounds: int = 100) -> dict[str, object]:
    """The candidates. The ridge's penalty is scaled so that it is the closed form of penalty RIDGE; boosting takes texts as ordered target statistics."""
    r = train.agg(F.stddev_pop(target).alias("s"), F.count(target).alias("n")).first()
    common = {"featuresCol": "features", "labelCol": target}
    return {
        "linear": LinearRegression(solver="normal", **common),
        "ridge": LinearRegression(solver="normal", regParam=RIDGE * (r["s"] or 0.0) / max(1, r["n"]), elasticNetParam=0.0, standardization=False, **common),
        "forest": RandomForestRegressor(numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=42, **common),
        "boosted": GBTRegressor(maxIter=rounds, maxDepth=6, stepSize=0.1, seed=42, **common),
    }


def pipeline(numbers: Sequence[str], texts: Sequence[str], regressor: object, n: int | None = None) -> Pipeline:
    """Numbers scaled, texts one-hot (unknown ones as a value of their own). n: the rows to be fitted, for the population's deviation instead of the sample's."""
    stages: list = []
    inputs = []
    if numbers:
        stages += [VectorAssembler(inputCols=list(numbers), outputCol="_numbers", handleInvalid="error"), StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True)]
        inputs.append("_scaled")
        if n is not None and n > 1:
            stages.append(ElementwiseProduct(inputCol="_scaled", outputCol="_standard", scalingVec=Vectors.dense([math.sqrt(n / (n - 1))] * len(numbers))))
            inputs = ["_standard"]
    if texts:
        stages += [StringIndexer(inputCols=list(texts), outputCols=[f"_{c}_i" for c in texts], handleInvalid="keep"), OneHotEncoder(inputCols=[f"_{c}_i" for c in texts], outputCols=[f"_{c}_v" for c in texts])]
        inputs += [f"_{c}_v" for c in texts]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=inputs, outputCol="features"), regressor])


def fit_ordered(train: DataFrame, numbers: Sequence[str], texts: Sequence[str], target: str, keys: Sequence[str], regressor: object) -> PipelineModel:
    """Fits trees on numbers as they are and on texts as ordered target statistics; the model scores with the whole training rows' means."""
    encoders = categories.encoders(texts, target) if texts else []
    told = Pipeline(stages=encoders).fit(train)
    assembled = VectorAssembler(inputCols=[*numbers, *(categories.named(c) for c in texts)], outputCol="features")
    rows = staged(categories.ordered(train.select(*dict.fromkeys([*keys, *numbers, *texts, target])), texts, target, keys)) if texts else train
    rows = rows.coalesce(max(1, -(-rows.count() // TASK_ROWS)))
    return PipelineModel(stages=[*told.stages, assembled, regressor.fit(assembled.transform(rows))])


def _fit(name: str, train: DataFrame, numbers: Sequence[str], texts: Sequence[str], target: str, regressor: object, n: int) -> PipelineModel:
    if name == "boosted":
        return fit_ordered(train, numbers, texts, target, [c for c in (R.TRIP, "segment_id") if c in train.columns] or list(train.columns), regressor)
    return pipeline(numbers, texts, regressor, n).fit(train)


def fit_all(train: DataFrame, test: DataFrame, numbers: Sequence[str], texts: Sequence[str], target: str, only: Sequence[str] = (), **sizes: int) -> tuple[dict[str, PipelineModel], DataFrame]:
    """Fits each candidate on the training rows that are whole, and measures it on the test rows. Rows or columns that
    can't be fitted give a row of nulls and the reason; other failures are raised.

    The candidates are fitted at the same time: boosting is hundreds of short jobs one after the other, which leave cores to the others.
    """
    used = [*numbers, *texts]
    train = train.dropna(subset=[*used, target])
    n = train.count()
    found = {k: r for k, r in regressors(train, target, **sizes).items() if not only or k in only}

    def one(name: str) -> tuple[PipelineModel | None, tuple]:
        try:
            model = _fit(name, train, numbers, texts, target, found[name], n)
            m = metrics.regression_metrics(model.transform(test.dropna(subset=used)), target, "prediction").first()
            return model, (name, m["mae"], m["rmse"], m["r2"], m["n"], None)
        except (IllegalArgumentException, ArithmeticException) as e:
            return None, (name, None, None, None, 0, str(e)[:500])

    with ThreadPoolExecutor(max(1, len(found))) as pool:  # wrapped one by one: each thread has properties of its own
        begun = {k: pool.submit(inheritable_thread_target(test.sparkSession)(one), k) for k in found}
        told = {k: f.result() for k, f in begun.items()}
    fitted = {k: model for k, (model, _) in told.items() if model is not None}
    return fitted, test.sparkSession.createDataFrame([row for _, row in told.values()], "model string, mae double, rmse double, r2 double, n long, failure string")


def with_best(train: DataFrame, test: DataFrame, numbers: Sequence[str], texts: Sequence[str], target: str, then: Callable[[PipelineModel], DataFrame], **sizes: int) -> DataFrame:
    """`then` of the best of all candidates.

    It begins with the best of those that are fitted soon, while the late ones still are, and once more, what has begun
    being cancelled, where a late one turns out better: the result is that of the best in any case.
    """
    sc, tag = train.sparkSession.sparkContext, f"ahead-{uuid.uuid4().hex}"
    best = lambda table: getattr(metrics.best_model(table).first(), "model", None)

    def ahead(model: PipelineModel) -> DataFrame:
        sc.addJobTag(tag)
        return then(model)

    with ThreadPoolExecutor(2) as pool:
        rest = pool.submit(inheritable_thread_target(train.sparkSession)(lambda: fit_all(train, test, numbers, texts, target, LATE, **sizes)))
        fitted, table = fit_all(train, test, numbers, texts, target, SOON, **sizes)
        first = best(table)
        begun = pool.submit(inheritable_thread_target(train.sparkSession)(ahead), fitted[first]) if first in fitted else None
        chosen = first
        try:
            more, late = rest.result()
            chosen = best(table.unionByName(late))
            fitted |= more
        except BaseException:
            chosen = None
            raise
        finally:
            while begun and chosen != first and not begun.done():
                sc.cancelJobsWithTag(tag)
                wait([begun], 1)
        return begun.result() if begun and chosen == first else then(fitted[chosen])


def importances(model: PipelineModel, rows: DataFrame) -> list[tuple[str, float]]:
    """Inputs by importance or size of coefficient, largest first, named as the transformed `rows` tell; a one-hot text has one for each value."""
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    kinds = model.transform(rows.limit(1)).schema["features"].metadata["ml_attr"]["attrs"]
    names = {x["idx"]: x.get("name", f"features_{x['idx']}") for group in kinds.values() for x in group}
    numbers = next((s.getInputCols() for s in model.stages if isinstance(s, VectorAssembler) and s.getOutputCol() == "_numbers"), [])
    named = {f"{p}_{k}": c for p in ("_scaled", "_standard") for k, c in enumerate(numbers)}
    named |= {categories.named(c): c for s in model.stages if isinstance(s, StringIndexerModel) for c in s.getInputCols()}
    return sorted(((named.get(names[k], names[k]), v) for k, v in enumerate(values.tolist())), key=lambda x: (-x[1], x[0]))


def residual_model(segments: DataFrame, numbers: Sequence[str], texts: Sequence[str], residual: str, prediction: str, outcome: str, test: float = 0.25, only: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(predictions, metrics): a model of a first model's residual, chosen on held-out trips and refitted on all.

    predictions: personal_residual, personal_prediction and personal_error of each whole segment, and is_test;
    errors on the test trips are from before the refit, so they are not measured on rows that were fitted.
    """
    parts = staged(selection.split_trips(segments, test))
    train, held = parts.where("not is_test"), parts.where("is_test")
    flat = selection.low_variance(train, numbers)
    numbers = [c for c in numbers if c not in flat]
    numbers = [c for c in numbers if c not in selection.collinear(train, numbers)]
    fitted, table = fit_all(train, held, numbers, texts, residual, only)
    chosen = metrics.best_model(table).first()["model"]
    whole = parts.dropna(subset=[*numbers, *texts, residual])
    final = _fit(chosen, whole, numbers, texts, residual, regressors(whole, residual)[chosen], whole.count())
    keep = [c for c in (R.TRIP, "segment_id", outcome, prediction, residual, "is_test") if c in parts.columns]

    def scored(rows: DataFrame, model: PipelineModel) -> DataFrame:
        out = model.transform(rows.dropna(subset=[*numbers, *texts])).select(*keep, F.col("prediction").alias("personal_residual"))
        out = out.withColumn("personal_prediction", F.col(prediction) + F.col("personal_residual"))
        return out.withColumn("personal_error", F.col(outcome) - F.col("personal_prediction"))

    return scored(held, fitted[chosen]).unionByName(scored(train, final)), table
