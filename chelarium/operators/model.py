"""Boosted trees over the feature matrix: fit with early stopping, tune, rank and explain.

Differences from a native gradient booster are Spark ML's: absent numbers are a constant, as trees take no
NaN; features are drawn per node; there is no L1 or L2 penalty. Early stopping has patience: the model is fitted in
full, scored per tree on the held-out rows, and cut after the best number of trees.
"""

from __future__ import annotations

import hashlib
import json
import math
import statistics
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chelarium.functions import exprs, protein, vocab
from chelarium.operators import folds as folding
from chelarium.operators import ranks
from chelarium.operators.features import ABSENT_NUMBER
from chelarium.session import exists, settle

MODEL_NAME = "boosted trees"
MIN_MOTIFS, REDUCED_CONFIDENCE = 3, ("Samarium",)
OUTER_FOLDS, INNER_FOLDS = 5, 7


@dataclass
class TreeParams:
    """Search dimensions that map onto Spark ML."""

    rounds: int = 60
    step: float = 0.1
    depth: int = 5
    subsample: float = 0.8
    feature_share: str = "0.8"
    min_rows: int = 1
    seed: int = 42


@dataclass
class Fitted:
    model: PipelineModel
    names: list[str]
    best_round: int
    holdout_rmse: float
    params: TreeParams = field(default_factory=TreeParams)

    @property
    def trees(self) -> GBTRegressionModel:
        return self.model.stages[-1]


def _dense(df: DataFrame, names: list[str]) -> DataFrame:
    filled = {c: F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), ABSENT_NUMBER).otherwise(F.col(c).cast("double")) for c in names}
    return df.withColumns(filled)


def _pipeline(names: list[str], p: TreeParams, rounds: int) -> Pipeline:
    trees = GBTRegressor(
        featuresCol="features", labelCol="value", predictionCol="predicted", maxIter=rounds, stepSize=p.step, maxDepth=p.depth,
        subsamplingRate=p.subsample, featureSubsetStrategy=p.feature_share, minInstancesPerNode=p.min_rows, seed=p.seed,
    )
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), trees])


def _first_trees(model: GBTRegressionModel, n: int) -> GBTRegressionModel:
    """The model of the first n trees; boosting draws by round, so a fit of n rounds would give the same trees."""
    sc = SparkContext.getOrCreate()
    java = sc._jvm.org.apache.spark.ml.regression
    trees = sc._gateway.new_array(java.DecisionTreeRegressionModel, n)
    weights = sc._gateway.new_array(sc._jvm.double, n)
    for i, (tree, weight) in enumerate(zip(list(model._java_obj.trees())[:n], model.treeWeights)):
        trees[i], weights[i] = tree, weight
    cut = GBTRegressionModel(java.GBTRegressionModel(model.uid, trees, weights, model.numFeatures))
    return cut.setFeaturesCol(model.getFeaturesCol()).setPredictionCol(model.getPredictionCol())


def fit_with_holdout(train: DataFrame, holdout: DataFrame, names: list[str], params: TreeParams | None = None) -> Fitted:
    """Fitted in full, then cut after the best number of trees by holdout error."""
    p = params or TreeParams()
    full = _pipeline(names, p, p.rounds).fit(_dense(train, names))
    scored = full.stages[0].transform(_dense(holdout, names))
    errors = full.stages[-1].evaluateEachIteration(scored, "squared")
    best = int(np.argmin(errors)) + 1
    final = PipelineModel([full.stages[0], _first_trees(full.stages[-1], best)])
    return Fitted(final, names, best, math.sqrt(errors[best - 1]), p)


def predict(fitted: Fitted, df: DataFrame) -> DataFrame:
    """df with `predicted`."""
    return fitted.model.transform(_dense(df, fitted.names)).drop("features")


def importance(fitted: Fitted, spark) -> DataFrame:
    """(feature, importance), most important first."""
    values = fitted.trees.featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(fitted.names, values)), "feature string, importance double").orderBy(F.desc("importance"), "feature")


def sample_params(n: int, seed: int = 42, rounds: int = 60) -> list[TreeParams]:
    """Random draws of the search space: log-uniform step, depth, shares and leaf size."""
    rng = np.random.default_rng(seed)
    return [
        TreeParams(rounds, float(np.exp(rng.uniform(np.log(0.02), np.log(0.2)))), int(rng.integers(2, 8)), float(rng.uniform(0.6, 1)), f"{rng.uniform(0.5, 1):.4f}", int(rng.integers(1, 16)), seed)
        for _ in range(n)
    ]


def metric_bundle(predicted: DataFrame, expected: tuple[str, ...] = ()) -> DataFrame:
    """(kind, name, value) of predicted rows (value, predicted, target_element, variant_id): n, rmse, mae and r2 as `overall`, rank
    correlation as `element` and `variant`, their unweighted means as `macro`, and every expected element without one as `missing`."""
    rows = settle(predicted.select("value", "predicted", "target_element", "variant_id"))
    whole = ranks.regression_metrics(rows, "value", "predicted")
    parts = [whole.unpivot([], [F.col(c).cast("double").alias(c) for c in whole.columns], "name", "value").withColumn("kind", F.lit("overall"))]
    for kind, column in (("element", "target_element"), ("variant", "variant_id")):
        rho = settle(ranks.grouped_spearman(rows, column, "value", "predicted"))
        parts.append(rho.select(F.lit(kind).alias("kind"), F.col(column).alias("name"), F.col("rho").alias("value")))
        parts.append(ranks.macro_spearman(rho).select(F.lit("macro").alias("kind"), F.lit(kind).alias("name"), F.col("macro_rho").alias("value")))
        if kind == "element" and expected:
            listed = rows.sparkSession.createDataFrame([(e,) for e in expected], "name string")
            gone = listed.join(F.broadcast(rho.where("rho IS NOT NULL").select(F.col(column).alias("name"))), "name", "left_anti")
            parts.append(gone.select(F.lit("missing").alias("kind"), "name", F.lit(None).cast("double").alias("value")))
    out = parts[0].select("kind", "name", "value")
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fold_membership(rows: DataFrame, entity: str = "variant_id", stratum: str = "selectivity_cluster", outer: int = OUTER_FOLDS, inner: int = INNER_FOLDS, seed: int = 42) -> DataFrame:
    """(entity, fold, held_in): outer fold of every entity and the outer folds whose fits stop early by it; the same for all trials.

    The holdout of an outer fold is one of `inner` stratified parts of the other folds' entities.
    """
    entities = folding.entity_strata(rows, entity, stratum)
    folded = settle(folding.stratified_folds(entities, entity, stratum, outer, seed).select(entity, stratum, "fold"))
    held = [
        folding.stratified_folds(folded.where(F.col("fold") != k).select(entity, stratum), entity, stratum, inner, seed + k).where("fold = 0").select(entity, F.lit(k).alias("k"))
        for k in range(outer)
    ]
    every = held[0]
    for h in held[1:]:
        every = every.unionByName(h)
    # an entity is held in fewer than `outer` folds
    per = every.groupBy(entity).agg(F.array_sort(F.collect_set("k")).alias("held_in"))
    return settle(folded.join(per, entity, "left").select(entity, "fold", F.coalesce("held_in", F.array().cast("array<int>")).alias("held_in")))


def tune(rows: DataFrame, membership: DataFrame, names: list[str], draws: list[TreeParams], checkpoint: str, entity: str = "variant_id", parallel: int = 2) -> DataFrame:
    """trial_ranks of the draws: each is fitted on all outer folds but one less its inner holdout, which alone picks the number of
    trees, and scored on the outer fold by the mean over elements of the rank correlation.

    Each finished trial is written below `checkpoint`, and trials found there are not run again; use a new folder for other draws.
    """
    spark = rows.sparkSession
    joined = settle(rows.join(membership, entity))
    outer = sorted(r["fold"] for r in membership.select("fold").distinct().collect())
    # a folder per trial: trials that end at the same time don't share an output folder
    done = {t for t in range(len(draws)) if exists(spark, f"{checkpoint}/trial={t}/_SUCCESS")}

    def run(trial: int) -> None:
        found = []
        for k in outer:
            own = F.array_contains("held_in", k)
            fitted = fit_with_holdout(joined.where((F.col("fold") != k) & ~own), joined.where(own), names, draws[trial])
            rho = ranks.grouped_spearman(predict(fitted, joined.where(F.col("fold") == k)), "target_element", "value", "predicted")
            score = ranks.macro_spearman(rho).first()["macro_rho"]
            found.append((k, float("nan") if score is None else float(score), fitted.best_round, json.dumps(asdict(draws[trial]))))
        spark.createDataFrame(found, "fold int, score double, best_round int, params string").coalesce(1).write.mode("overwrite").parquet(f"{checkpoint}/trial={trial}")

    with ThreadPoolExecutor(parallel) as pool:
        list(pool.map(run, [t for t in range(len(draws)) if t not in done]))
    return trial_ranks(spark.read.parquet(checkpoint).withColumn("score", F.nanvl("score", F.lit(-1.0))))


def best_trial(spark, checkpoint: str) -> tuple[int, TreeParams]:
    """(trial, parameters) of the best mean score, the first of equal ones; rounds is the median over the folds of the number of trees."""
    rows = spark.read.parquet(checkpoint).where(~F.isnan("score")).collect()  # trials by folds
    if not rows:
        raise ValueError("no trial has a score: its predictions are constant within every element")
    by: dict = {}
    for r in rows:
        by.setdefault(r["trial"], []).append(r)
    trial = max(by, key=lambda t: (statistics.fmean(r["score"] for r in by[t]), -t))
    return trial, TreeParams(**(json.loads(by[trial][0]["params"]) | {"rounds": max(1, int(statistics.median(r["best_round"] for r in by[trial])))}))


def retrain(train: DataFrame, names: list[str], params: TreeParams) -> Fitted:
    """Fitted on all training rows with exactly params.rounds trees, without any holdout."""
    return Fitted(_pipeline(names, params, params.rounds).fit(_dense(train, names)), names, params.rounds, float("nan"), params)


def model_version(fitted: Fitted) -> str:
    """Same trees, same version: a hash of all trees and the feature names."""
    text = "\n".join([*fitted.names, fitted.trees.toDebugString.split("\n", 1)[1], *map(str, fitted.trees.treeWeights)])
    return f"gbt:{hashlib.sha256(text.encode()).hexdigest()[:12]}"


def save_fitted(fitted: Fitted, spark, folder: str, metrics: DataFrame | None = None, membership: DataFrame | None = None) -> None:
    """Model, its description, importances and, if given, metrics and fold membership below folder."""
    fitted.model.write().overwrite().save(f"{folder}/model")
    about = {"names": fitted.names, "best_round": fitted.best_round, "holdout_rmse": fitted.holdout_rmse, "params": asdict(fitted.params), "version": model_version(fitted)}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/about")
    for name, df in {"importance": importance(fitted, spark), "metrics": metrics, "folds": membership}.items():
        if df is not None:
            df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_fitted(spark, folder: str) -> Fitted:
    about = json.loads(spark.read.text(f"{folder}/about").first()["value"])
    return Fitted(PipelineModel.load(f"{folder}/model"), about["names"], about["best_round"], about["holdout_rmse"], TreeParams(**about["params"]))


def model_info(spark, folder: str) -> dict[str, str]:
    """Name, version and place of a saved model; the version is `unknown` where there is none."""
    version = json.loads(spark.read.text(f"{folder}/about").first()["value"])["version"] if exists(spark, f"{folder}/about") else "unknown"
    return {"model_name": MODEL_NAME, "model_version": version, "model_path": folder}


def trial_ranks(scores: DataFrame) -> DataFrame:
    """(trial, mean_score, std_score, median_round, rank) from scores (trial, score, best_round); trials are few."""
    per = scores.groupBy("trial").agg(
        F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score"), F.percentile("best_round", F.lit(0.5)).cast("int").alias("median_round")
    )
    return per.withColumn("rank", F.rank().over(Window.orderBy(F.desc("mean_score"))))


def ranked_profile(predictions: DataFrame) -> DataFrame:
    """Rank of each element within a sequence's predictions, with the confidence in it; ties go by the listed order of elements."""
    w = Window.partitionBy("seq_id").orderBy(F.desc("predicted"), F.asc("element_place"))
    reduced = F.col("target_element").isin(*REDUCED_CONFIDENCE)
    note = F.when(reduced, "reduced: most training values are at or near the upper end").otherwise("")
    number = exprs.choose(F.col("target_element"), {e[0]: e[1] for e in vocab.ELEMENTS})
    return predictions.withColumn("rank", F.row_number().over(w)).withColumns({"reduced_confidence": reduced, "confidence_note": note, "atomic_number": number})


def profile_summary(sequences: DataFrame, fitted: Fitted) -> DataFrame:
    """(seq_id, is_valid, error, sequence, length, n_motifs, warnings, model_name, model_version): every sequence, valid or not.

    Invalid sequences have an error, no warnings and no predictions; see features.profile_rows for the predictions of the others.
    """
    v = sequences.select("seq_id", protein.validated_sequence("sequence").alias("v"))
    n = F.when(F.col("v.is_valid"), F.size(protein.motifs(F.col("v.sequence")))).otherwise(0)
    few = F.when(F.col("n_motifs") < MIN_MOTIFS, F.format_string("few metal-binding motifs (%d): outside of what the model was trained on", "n_motifs"))
    warnings = F.when(F.col("v.is_valid"), F.array_compact(F.array(few, F.lit("reduced confidence: " + ", ".join(REDUCED_CONFIDENCE))))).otherwise(F.array().cast("array<string>"))
    made = v.withColumn("n_motifs", n).withColumn("warnings", warnings)
    return made.select("seq_id", "v.is_valid", "v.error", "v.sequence", "v.length", "n_motifs", "warnings", F.lit(MODEL_NAME).alias("model_name"), F.lit(model_version(fitted)).alias("model_version"))
