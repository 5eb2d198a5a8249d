"""Training, scoring and fusion of models with Spark ML.

A model is any function DataFrame -> DataFrame that adds a score column.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions import thresholds as T
from driftloom.functions.statistics import clip
from driftloom.operators.ordered import BUCKET, bucket_count, row_numbers
from driftloom.operators.quality import binary_metrics
from driftloom.sources.stage import stage

Scorer = Callable[[DataFrame], DataFrame]


def preprocessing(numeric: Sequence[str], categorical: Sequence[str] = (), *, scale: bool = True) -> list:
    """Scaled numerics and one-hot categoricals in ``features``; an unknown category is all zeros.

    A missing numeric takes the column's median of the training rows, so that every row is scored.
    """
    filled = [f"{c}_filled" for c in numeric]
    stages: list = [Imputer(inputCols=list(numeric), outputCols=filled, strategy="median")] if filled else []
    inputs = []
    for c in categorical:
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}_index", handleInvalid="keep", stringOrderType="alphabetAsc"))
        # the unknown category has the last index, which the encoder drops
        stages.append(OneHotEncoder(inputCol=f"{c}_index", outputCol=f"{c}_onehot", dropLast=True))
        inputs.append(f"{c}_onehot")
    raw = "numeric_raw" if scale else "numeric"
    stages.append(VectorAssembler(inputCols=filled, outputCol=raw))
    if scale:
        stages.append(StandardScaler(inputCol=raw, outputCol="numeric", withMean=True, withStd=True))
    stages.append(VectorAssembler(inputCols=["numeric", *inputs], outputCol="features"))
    return stages


def _weighted(df: DataFrame, label: str, positive: float) -> DataFrame:
    return df.withColumn("_weight", F.when(F.col(label) == 1, positive).otherwise(1.0))


def churn_classifier(
    df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str] = (), *, trees: int = 300, depth: int = 6,
    rate: float = 0.05, subsample: float = 0.8, positive_weight: float = 2.9, seed: int = 42,
) -> PipelineModel:
    """Boosted trees with a weight on the positive class."""
    gbt = GBTClassifier(
        labelCol=label, weightCol="_weight", maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=subsample, seed=seed
    )
    return Pipeline(stages=[*preprocessing(numeric, categorical), gbt]).fit(_weighted(df, label, positive_weight))


def fault_classifier(
    df: DataFrame, label: str, features: Sequence[str], *, trees: int = 200, depth: int = 4, positive_weight: float = 5.0,
    forest: bool = False, seed: int = 42,
) -> PipelineModel:
    """Boosted trees for rare faults, or a forest; faults weigh five times."""
    if forest:
        model = RandomForestClassifier(labelCol=label, weightCol="_weight", numTrees=min(trees, 100), maxDepth=depth, seed=seed)
    else:
        model = GBTClassifier(labelCol=label, weightCol="_weight", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed)
    return Pipeline(stages=[*preprocessing(features), model]).fit(_weighted(df, label, positive_weight))


def health_regressor(
    df: DataFrame, target: str, features: Sequence[str], *, trees: int = 300, depth: int = 5, rate: float = 0.05,
    subsample: float = 0.8, seed: int = 42,
) -> PipelineModel:
    gbt = GBTRegressor(labelCol=target, maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=subsample, seed=seed)
    return Pipeline(stages=[*preprocessing(features), gbt]).fit(df)


@dataclass
class Trend:
    """A ridge model on features scaled by their population mean and std."""

    features: list[str]
    mean: list[float]
    std: list[float]
    coefficients: list[float]
    intercept: float

    def predict(self) -> Column:
        """Prediction limited to 0..100, as one expression."""
        terms = [
            (F.col(f) - m) / s * c for f, m, s, c in zip(self.features, self.mean, self.std, self.coefficients, strict=True)
        ]
        return clip(sum(terms, F.lit(self.intercept)), 0.0, 100.0)


def degradation_trend(df: DataFrame, target: str, features: Sequence[str], *, alpha: float = 1.0) -> Trend:
    """Ridge regression with penalty alpha * |w|^2 beside the sum of squared errors.

    The solver divides the penalty by n and, as it scales the label, by the
    label's std; both are undone here.
    """
    features = list(features)
    rows = df.dropna(subset=[*features, target])
    moments = rows.agg(
        F.count(F.lit(1)).alias("n"), F.stddev_pop(target).alias("sy"),
        *[x for f in features for x in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"))],
    ).first()
    mean = [moments[f"m_{f}"] for f in features]
    std = [moments[f"s_{f}"] or 1.0 for f in features]
    scaled = rows.select(
        F.col(target).cast("double").alias("label"),
        *[((F.col(f) - m) / s).alias(f) for f, m, s in zip(features, mean, std, strict=True)],
    )
    vectors = VectorAssembler(inputCols=features, outputCol="features").transform(scaled)
    solver = LinearRegression(
        regParam=alpha / moments["n"] * (moments["sy"] or 1.0), elasticNetParam=0.0, standardization=False, solver="normal"
    )
    fit = solver.fit(vectors)
    return Trend(features, mean, std, list(fit.coefficients.toArray()), float(fit.intercept))


def flat_windows(windows: DataFrame, length: int, width: int) -> tuple[DataFrame, list[str]]:
    """Sequence windows as plain columns x_<step>_<feature>."""
    names = [f"x_{i}_{j}" for i in range(length) for j in range(width)]
    cells = [F.col("window")[i][j].alias(f"x_{i}_{j}") for i in range(length) for j in range(width)]
    return windows.select(*[c for c in windows.columns if c != "window"], *cells), names


def charge_from_sequences(windows: DataFrame, *, length: int, width: int, trees: int = 50, depth: int = 5, seed: int = 42) -> tuple[PipelineModel, Scorer]:
    """State of charge from flattened windows."""
    flat, names = flat_windows(windows, length, width)
    gbt = GBTRegressor(labelCol="target", maxIter=trees, maxDepth=depth, seed=seed)
    model = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), gbt]).fit(flat)

    def score(rows: DataFrame) -> DataFrame:
        flat = flat_windows(rows, length, width)[0]
        return clipped_prediction(model.transform(flat), 0.0, 1.0, [c for c in flat.columns if c not in names])

    return model, score


_INTERNAL = ("features", "numeric", "numeric_raw", "rawPrediction", "probability", "prediction")


def _without_internals(df: DataFrame, own: Sequence[str] = ()) -> DataFrame:
    """Drops what the pipeline added; ``own`` are the columns that came in."""
    return df.drop(*[c for c in df.columns if c not in own and (c in _INTERNAL or c.endswith(("_index", "_onehot", "_filled")))])


def clipped_prediction(scored: DataFrame, lo: float, hi: float, own: Sequence[str], out: str = "prediction") -> DataFrame:
    """The model's prediction, clipped, beside the columns ``own`` that the rows had before the model."""
    kept = scored.withColumn("_p", clip(F.col("prediction"), lo, hi))
    return _without_internals(kept, [c for c in own if c != "prediction"]).withColumnRenamed("_p", out)


def score_table(model: PipelineModel, df: DataFrame, *, threshold: float = T.DEFAULT_THRESHOLD) -> DataFrame:
    """Add ``score`` (probability of class 1) and ``predicted`` to every row."""
    scored = model.transform(df).withColumn("score", vector_to_array("probability")[1])
    return _without_internals(scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")), df.columns)


def prediction_spread(
    df: DataFrame, train: DataFrame, target: str, features: Sequence[str], *, key: Sequence[str], models: int = 20, trees: int = 20,
    depth: int = 5, seed: int = 42,
) -> DataFrame:
    """Mean and population std per row over models fitted on resampled rows."""
    out = df
    for i in range(models):
        bag = train.sample(withReplacement=True, fraction=1.0, seed=seed + i)
        fit = health_regressor(bag, target, features, trees=trees, depth=depth, seed=seed + i)
        out = clipped_prediction(fit.transform(out), 0.0, 1.0, out.columns, f"_p{i}")
    all_p = F.array(*[F.col(f"_p{i}") for i in range(models)])
    out = out.withColumn("_all", all_p)
    mean = F.aggregate("_all", F.lit(0.0), lambda a, x: a + x) / models
    out = out.withColumn("mean_prediction", mean)
    var = F.aggregate(F.transform("_all", lambda x: F.pow(x - F.col("mean_prediction"), 2)), F.lit(0.0), lambda a, x: a + x) / models
    return out.withColumn("std_prediction", F.sqrt(var)).drop("_all", *[f"_p{i}" for i in range(models)])


def feature_importances(model: PipelineModel, scored: DataFrame, top: int = 15) -> DataFrame:
    """Names and importances of the strongest features; one row per model input."""
    spark = scored.sparkSession
    attrs = scored.schema["features"].metadata["ml_attr"]["attrs"]
    names = {int(a["idx"]): a.get("name", f"feature_{a['idx']}") for kind in attrs.values() for a in kind}
    # the scaler loses the names of its inputs
    numeric = next(s for s in model.stages if isinstance(s, VectorAssembler)).getInputCols()
    names.update({i: numeric[i].removesuffix("_filled") for i, name in names.items() if name == f"numeric_{i}"})
    weights = model.stages[-1].featureImportances.toArray()
    rows = [(names.get(i, f"feature_{i}"), float(w)) for i, w in enumerate(weights)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(top)


def stratified_folds(df: DataFrame, label: str, key: Sequence[str], folds: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold``: rank by key hash within each class, dealt out in turn."""
    n = bucket_count(df.sparkSession)
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    head = F.conv(F.substring("_hash", 1, 8), 16, 10).cast("double")
    rows = df.withColumn("_hash", digest).withColumn(BUCKET, F.floor(head / float(2**32) * n).cast("int"))
    rows = row_numbers(rows, [label], ["_hash", *key], out="_rank")
    return rows.withColumn("fold", F.pmod(F.col("_rank"), F.lit(folds)).cast("int")).drop("_hash", "_rank")


def search_parameters(
    df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str] = (), *, key: Sequence[str], grid: dict[str, Sequence],
    folds: int = 5, trees: int = 20, parallelism: int = 2, seed: int = 42,
) -> CrossValidatorModel:
    """Grid search with stratified folds on AUC, as CrossValidator does it.

    The folds are dealt once and staged.  The grid varies only the trees, so a fold's preprocessing is fitted and applied
    once for all of its trials.
    """
    gbt = GBTClassifier(labelCol=label, maxIter=trees, seed=seed)
    prepare = preprocessing(numeric, categorical)
    params = ParamGridBuilder()
    for name, values in grid.items():
        params = params.addGrid(getattr(gbt, name), list(values))
    search = CrossValidator(
        estimator=Pipeline(stages=[*prepare, gbt]), estimatorParamMaps=params.build(), evaluator=BinaryClassificationEvaluator(labelCol=label),
        numFolds=folds, foldCol="fold", parallelism=parallelism, seed=seed,
    )
    trials, judge = search.getEstimatorParamMaps(), search.getEvaluator()
    used = df.select(*dict.fromkeys([*key, label, *numeric, *categorical]))
    rows = stage(stratified_folds(used, label, key, folds, seed), "search-folds")
    metrics = np.zeros((folds, len(trials)))
    with ThreadPool(min(parallelism, len(trials))) as pool:
        for fold in range(folds):
            parts = {"training": rows.filter(F.col("fold") != fold), "validation": rows.filter(F.col("fold") == fold)}
            for part, of_part in parts.items():
                if of_part.isEmpty():
                    raise ValueError(f"The {part} data at fold {fold} is empty.")
            fitted = Pipeline(stages=prepare).fit(parts["training"])
            train, held = (fitted.transform(of_part).select(label, "features").persist() for of_part in parts.values())

            def trial(at: int) -> float:
                return judge.evaluate(gbt.fit(train, trials[at]).transform(held))

            try:
                metrics[fold] = pool.map(inheritable_thread_target(df.sparkSession)(trial), range(len(trials)))
            finally:
                train.unpersist()
                held.unpersist()
    mean = metrics.mean(axis=0)
    best = search.getEstimator().fit(rows, trials[int(mean.argmax())])
    found = CrossValidatorModel(best, mean.tolist(), None, metrics.std(axis=0).tolist())
    for p in found.params:
        if search.isSet(p.name):
            found.set(p, search.getOrDefault(p.name))
    return found


def best_trials(model: CrossValidatorModel, df: DataFrame, top: int = 5) -> DataFrame:
    rows = [
        (i, ", ".join(f"{p.name}={v}" for p, v in sorted(params.items(), key=lambda x: x[0].name)), float(m))
        for i, (params, m) in enumerate(zip(model.getEstimatorParamMaps(), model.avgMetrics, strict=True))
    ]
    trials = df.sparkSession.createDataFrame(rows, "trial int, parameters string, auc double")
    return trials.orderBy(F.desc("auc"), "trial").limit(top)


# Promotion -------------------------------------------------------------------------


def promotion(df: DataFrame, old: str = "old_auc", new: str = "new_auc", gain: float = T.MIN_PROMOTION_GAIN) -> DataFrame:
    """Promote a retrained model when its holdout AUC gains enough."""
    better = F.col(new) - F.col(old)
    promoted = F.coalesce(better >= gain, F.lit(False))
    won = F.format_string("New model AUC %.4f beats old %.4f by %.4f", F.col(new), F.col(old), better)
    lost = F.format_string(
        f"New model AUC %.4f did not improve over %.4f (improvement=%.4f < {gain})", F.col(new), F.col(old), better
    )
    return df.withColumn("promoted", promoted).withColumn("promotion_reason", F.when(promoted, won).otherwise(lost))


def retrain(
    labelled_batches: DataFrame, holdout: DataFrame, label: str, fit: Callable[[DataFrame], PipelineModel],
    current: PipelineModel, *, key: Sequence[str],
) -> tuple[PipelineModel, DataFrame]:
    """Fit on the recent labelled rows without the holdout's keys and decide on promotion."""
    rows = labelled_batches.dropna(subset=[label]).join(holdout.select(*key).distinct(), list(key), "left_anti")
    new = fit(rows)

    def auc(model: PipelineModel) -> DataFrame:
        return binary_metrics(score_table(model, holdout), label, "score").select("auc_roc")

    decision = (
        auc(current).select(F.col("auc_roc").alias("old_auc"), F.lit(1).alias("_k"))
        .join(auc(new).select(F.col("auc_roc").alias("new_auc"), F.lit(1).alias("_k")), "_k").drop("_k")
    )
    return new, promotion(decision)


# Fusion ----------------------------------------------------------------------------


def fuse_predictions(
    df: DataFrame, *, soh: str, fade: str, soc: str, fault: str, thermal: str, weights: tuple[float, float, float] = (0.50, 0.25, 0.25),
    fault_at: float = 0.35, thermal_at: float = 0.10,
) -> DataFrame:
    """One health estimate from the signals each row has, with fault flag, severity and action.

    The weights are renormalised over the signals present; with none, 0.8.
    """
    signals = [F.col(soh), F.greatest(F.lit(0.0), 1 - F.col(fade) / 100), F.col(soc)]
    present = [F.col(soh), F.col(fade), F.col(soc)]
    total = sum((F.when(p.isNotNull(), w).otherwise(0.0) for p, w in zip(present, weights, strict=True)), F.lit(0.0))
    mass = sum(
        (F.when(p.isNotNull(), s * w).otherwise(0.0) for p, s, w in zip(present, signals, weights, strict=True)), F.lit(0.0)
    )
    out = df.withColumns({"_total": total, "_mass": mass})
    estimate = F.when(F.col("_total") > 0, F.col("_mass") / F.when(F.col("_total") > 0, F.col("_total"))).otherwise(0.8)
    out = out.withColumn("soh_estimate", clip(estimate, 0.0, 1.0)).drop("_total", "_mass")
    fault_p, risk = F.coalesce(fault, F.lit(0.0)), F.coalesce(thermal, F.lit(0.0))
    flag = (fault_p >= fault_at) | (risk >= thermal_at)
    s = F.col("soh_estimate")
    severity = F.when(flag, "critical").when(s >= 0.80, "healthy").when(s >= 0.70, "warning").otherwise("critical")
    action = (
        F.when(flag, "⚠️ FAULT DETECTED. Immediate inspection required. Consider shutdown.")
        .when(s >= 0.80, "Continue normal operation. Schedule routine check in 3 months.")
        .when(s >= 0.70, "SOH declining. Reduce fast-charging frequency. Schedule inspection.")
        .otherwise("SOH below 70%. Battery replacement recommended within 30 days.")
    )
    return out.withColumns(
        {
            "fault_probability": fault_p,
            "fault_flag": flag,
            "capacity_fade_estimate": F.coalesce(fade, F.lit(0.0)),
            "degradation_severity": severity,
            "recommended_action": action,
        }
    )
