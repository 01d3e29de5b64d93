"""Classifiers for bad reviews on Spark ML: training, scoring, comparison and scenarios."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial, reduce
from itertools import islice

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sellerscope.operators.boosting import ONE_TASK_ROWS, fit_in_one_task
from sellerscope.operators.metrics import best_model, evaluate, model_ranking, roc_auc, with_prediction
from sellerscope.operators.splits import oversample, time_split, with_balanced_weight
from sellerscope.session import ROW_KEYS, side_by_side, stage, stage_with_row_keys
from sellerscope.settings import FEATURE_COLUMNS, RANDOM_SEED
from sellerscope.sources.artifacts import stage_model

LABEL = "is_negative"

# Training parameters of the compared models.
LOGISTIC_C = 1.0
LOGISTIC_MAX_ITER = 2000
BOOST_STEP = 0.05
BOOST_ROW_SHARE = 0.9
BOOST_COLUMN_SHARE = "0.8"
SHALLOW_TREES, SHALLOW_DEPTH = 400, 5
DEEP_TREES, DEEP_DEPTH = 500, 6
MLP_HIDDEN = (64, 32, 16)
MLP_MAX_ROUNDS = 40
MLP_PATIENCE = 6
MLP_MIN_GAIN = 1e-4
MLP_BLOCK = 512


@dataclass(frozen=True)
class Comparison:
    """Fitted models by name, their metrics (best first) and the name of the best one."""

    models: dict[str, PipelineModel]
    metrics: DataFrame
    best: str


def scaling_stages(train: DataFrame, columns: Sequence[str] = FEATURE_COLUMNS) -> list:
    """Pipeline stages that scale by the train rows' mean and population deviation.

    The figures, two per column, become part of the saved pipeline.
    """
    figures = []
    for name in columns:
        figures += [F.avg(name).alias(f"{name}_mean"), F.stddev_pop(name).alias(f"{name}_dev")]
    fit = train.agg(*figures).first()
    scaled = ", ".join(
        f"(`{c}` - {fit[f'{c}_mean']!r}D) / {(fit[f'{c}_dev'] or 1.0)!r}D AS `scaled_{c}`"
        for c in columns
    )
    return [
        SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__"),
        VectorAssembler(inputCols=[f"scaled_{c}" for c in columns], outputCol="features"),
    ]


def fit_logistic(
    train: DataFrame,
    columns: Sequence[str] = FEATURE_COLUMNS,
    c: float = LOGISTIC_C,
    max_iter: int = LOGISTIC_MAX_ITER,
) -> PipelineModel:
    """Logistic regression on scaled features with balanced class weights."""
    weighted = with_balanced_weight(train, LABEL)
    classifier = LogisticRegression(
        labelCol=LABEL,
        weightCol="weight",
        standardization=False,
        regParam=1.0 / (c * train.count()),
        maxIter=max_iter,
    )
    fitted = Pipeline(stages=[*scaling_stages(train, columns), classifier]).fit(weighted)
    return stage_model(train.sparkSession, fitted, "logistic-model")


def fit_boosted(
    train: DataFrame,
    columns: Sequence[str] = FEATURE_COLUMNS,
    trees: int = SHALLOW_TREES,
    depth: int = SHALLOW_DEPTH,
    weighting: str = "positive",
    seed: int = RANDOM_SEED,
) -> PipelineModel:
    """Gradient-boosted trees, weighted by negatives per positive or by balanced class weights.

    Rows that fit a task are trained in one, others by a job for every level: the trees are the same.
    """
    if weighting == "balanced":
        weighted = with_balanced_weight(train, LABEL)
    else:
        sizes = train.agg(
            F.count_if(F.col(LABEL) == 1).alias("pos"), F.count_if(F.col(LABEL) == 0).alias("neg")
        ).first()
        ratio = sizes["neg"] / max(sizes["pos"], 1)
        weighted = train.withColumn("weight", F.when(F.col(LABEL) == 1, ratio).otherwise(1.0))
    classifier = GBTClassifier(
        labelCol=LABEL,
        weightCol="weight",
        maxIter=trees,
        maxDepth=depth,
        stepSize=BOOST_STEP,
        subsamplingRate=BOOST_ROW_SHARE,
        featureSubsetStrategy=BOOST_COLUMN_SHARE,
        seed=seed,
    )
    assembler = VectorAssembler(inputCols=list(columns), outputCol="features")
    if 0 < train.count() <= ONE_TASK_ROWS:
        return PipelineModel([assembler, fit_in_one_task(classifier, weighted, columns)])
    return Pipeline(stages=[assembler, classifier]).fit(weighted)


def score(model: PipelineModel, frame: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and ``score``, the probability of a bad review."""
    return model.transform(frame).select(*keep, vector_to_array("probability")[1].alias("score"))


def scored_labels(model: PipelineModel, frame: DataFrame) -> DataFrame:
    """Stored (label, score) rows: the exact metrics read them more than once."""
    scored = score(model, frame, LABEL).withColumnRenamed(LABEL, "label")
    return stage(scored, "scored")


def timed_parts(
    features: DataFrame, validation_fraction: float | None = None
) -> dict[str, DataFrame]:
    """Train, test and, if asked for, validation rows of a feature matrix, stored with row keys.

    The row keys make the cut exact even inside a run of equal rows.
    """
    stored = stage_with_row_keys(features, "split-rows")
    ties = ("order_id", "review_score", *ROW_KEYS)
    split = time_split(stored, ties=ties, validation_fraction=validation_fraction)
    names = ("train", "test") if validation_fraction is None else ("train", "val", "test")
    return {name: split.filter(F.col("split") == name).drop("split") for name in names}


def trainers(
    shallow_trees: int = SHALLOW_TREES, deep_trees: int = DEEP_TREES, seed: int = RANDOM_SEED
) -> dict[str, Callable[[DataFrame], PipelineModel]]:
    """The compared models by name, and how each is trained."""
    return {
        "logistic": fit_logistic,
        "boosted_shallow": lambda train: fit_boosted(train, trees=shallow_trees, seed=seed),
        "boosted_deep": lambda train: fit_boosted(
            train, trees=deep_trees, depth=DEEP_DEPTH, weighting="balanced", seed=seed
        ),
    }


def compare_models(
    features: DataFrame,
    shallow_trees: int = SHALLOW_TREES,
    deep_trees: int = DEEP_TREES,
    seed: int = RANDOM_SEED,
) -> Comparison:
    """Train the three models on the earlier 80 % of a feature matrix, test on the rest."""
    parts = timed_parts(features)
    return compare_on(parts["train"].drop(*ROW_KEYS), parts["test"].drop(*ROW_KEYS), shallow_trees, deep_trees, seed)


def fit_and_evaluate(
    name: str, fit: Callable[[DataFrame], PipelineModel], train: DataFrame, test: DataFrame
) -> tuple[PipelineModel, DataFrame]:
    """A model trained on ``train`` and its stored row of metrics on ``test``."""
    model = fit(train)
    return model, stage(evaluate(scored_labels(model, test), name), "metrics")


def compare_on(
    train: DataFrame,
    test: DataFrame,
    shallow_trees: int = SHALLOW_TREES,
    deep_trees: int = DEEP_TREES,
    seed: int = RANDOM_SEED,
) -> Comparison:
    """Train the three models on ``train`` and rank them on ``test``; both should be stored tables."""
    known = trainers(shallow_trees, deep_trees, seed)
    found = side_by_side({name: partial(fit_and_evaluate, name, fit, train, test) for name, fit in known.items()})
    metrics = reduce(DataFrame.unionByName, (row for _, row in found.values()))
    models = {name: model for name, (model, _) in found.items()}
    return Comparison(models, model_ranking(metrics), best_model(metrics).first()["model"])


def predictions(model: PipelineModel, frame: DataFrame, *keep: str) -> DataFrame:
    """Label, score and class at 0.5, next to the ``keep`` columns."""
    scored = score(model, frame, *keep, LABEL).withColumnRenamed(LABEL, "label")
    return with_prediction(scored)


@dataclass(frozen=True)
class NeuralResult:
    model: PipelineModel
    metrics: DataFrame


@dataclass
class RoundLog:
    """Models of the training rounds with their validation figures, and where the best one stands.

    A round is the best so far if it beats the best before it by more than ``min_gain``.
    """

    patience: int
    min_gain: float
    rounds: list[tuple[MultilayerPerceptronClassificationModel, float]] = field(default_factory=list)
    best: int = 0

    def add(self, model: MultilayerPerceptronClassificationModel, figure: float | None) -> None:
        self.rounds.append((model, -1.0 if figure is None else figure))
        if self.rounds[-1][1] > self.rounds[self.best][1] + self.min_gain:
            self.best = len(self.rounds) - 1

    @property
    def stalled(self) -> bool:
        """Whether as many rounds as patience allows have passed since the best one."""
        return len(self.rounds) - 1 - self.best >= self.patience


def _network_rounds(
    inputs: DataFrame, hidden: Sequence[int], steps: int, seed: int
) -> Iterator[MultilayerPerceptronClassificationModel]:
    """Networks trained on and on, each for ``steps`` iterations from the weights of the one before."""
    network = MultilayerPerceptronClassifier(
        labelCol=LABEL,
        layers=[len(FEATURE_COLUMNS), *hidden, 2],
        maxIter=steps,
        blockSize=MLP_BLOCK,
        seed=seed,
    )
    while True:
        fitted = network.fit(inputs)
        yield fitted
        network = network.copy().setInitialWeights(fitted.weights)


def train_mlp(
    features: DataFrame,
    hidden: Sequence[int] = MLP_HIDDEN,
    max_rounds: int = MLP_MAX_ROUNDS,
    patience: int = MLP_PATIENCE,
    steps_per_round: int = 5,
    seed: int = RANDOM_SEED,
) -> NeuralResult:
    """Multilayer perceptron on oversampled train rows, stopped early on validation ROC-AUC.

    Spark's network has no class weights, so positives are drawn up to the negatives. Training goes
    on in short rounds from the last weights; the weights of the best round are kept.
    """
    parts = timed_parts(features, validation_fraction=0.1)
    scaling = Pipeline(stages=scaling_stages(parts["train"])).fit(parts["train"])
    balanced = oversample(parts["train"], ["order_id", "review_score", *ROW_KEYS], seed=seed)
    inputs = stage(scaling.transform(balanced).select(LABEL, "features"), "mlp-train")
    validation = stage(scaling.transform(parts["val"]).select(LABEL, "features"), "mlp-val")

    log = RoundLog(patience, MLP_MIN_GAIN)
    for fitted in islice(_network_rounds(inputs, hidden, steps_per_round, seed), max_rounds):
        scored = score(PipelineModel([fitted]), validation, LABEL).withColumnRenamed(LABEL, "label")
        log.add(fitted, roc_auc(scored).first()["roc_auc"])
        if log.stalled:
            break
    final = PipelineModel([*scaling.stages, log.rounds[log.best][0]])
    metrics = evaluate(scored_labels(final, parts["test"]), "perceptron").select(
        "*",
        F.lit(round(log.rounds[log.best][1], 4)).alias("best_val_roc_auc"),
        F.lit(len(log.rounds)).alias("epochs_trained"),
    )
    return NeuralResult(final, metrics)


# The inputs of a scenario.
SCENARIO_COLUMNS = [
    "delivery_days",
    "estimated_delivery_days",
    "seller_avg_review_hist",
    "price_total",
    "freight_total",
    "n_items",
]


def scenario_rows(
    scenarios: DataFrame, typical: dict[str, float], columns: Sequence[str] = FEATURE_COLUMNS
) -> DataFrame:
    """Complete feature rows: typical values, replaced where a scenario names its own.

    ``scenarios`` holds an id column and the six inputs; the freight ratio follows from them.
    """
    ids = [c for c in scenarios.columns if c not in SCENARIO_COLUMNS]
    ratio = F.col("freight_total") / F.greatest(F.col("price_total"), F.lit(1.0))
    values = {c: F.lit(typical[c]) for c in columns}
    values.update({c: F.col(c).cast("double") for c in SCENARIO_COLUMNS})
    values["freight_ratio"] = ratio
    return scenarios.select(*ids, *[values[c].alias(c) for c in columns])
