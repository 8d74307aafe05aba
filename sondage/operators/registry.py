"""The models by task and name: how each is built, its parameters as text, its grid.

Stages hand each other parameters as maps of text (``C -> 1.0``), the form in which they
are stored. A setting couples such a name with an MLlib parameter, one way and back:
``estimator`` reads a map, ``described`` writes the map of an estimator, and reading that
again gives an equal estimator. Names without an MLlib counterpart (kernel, solver,
activation) are carried along in a map and change nothing.

MLlib has no kernel SVR and no MLP regressor. Their names stand for what takes their places,
boosted trees and factorisation machines, which have parameters and grids of their own.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import product

from pyspark.ml import Estimator
from pyspark.ml.classification import (
    LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.regression import FMRegressor, GBTRegressor, LinearRegression, RandomForestRegressor

SEED = 42
DEEPEST = 30  # MLlib's deepest tree stands for a depth without limit


@dataclass(frozen=True)
class Sizes:
    """What of the data a parameter may depend on."""

    rows: int
    n_features: int
    n_classes: int = 0


@dataclass(frozen=True)
class Setting:
    """One parameter: its MLlib name, its value from text and its text from the value."""

    param: str
    read: Callable[[str, Sizes], object]
    write: Callable[[object, Sizes], str]


def _plain(param: str, kind: type) -> Setting:
    return Setting(param, lambda text, sizes: kind(text), lambda value, sizes: str(value))


def _layers(text: str, sizes: Sizes) -> list[int]:
    hidden = ast.literal_eval(text)
    return [sizes.n_features, *(hidden if isinstance(hidden, tuple) else (hidden,)), max(sizes.n_classes, 2)]


DEPTH = Setting("maxDepth", lambda text, sizes: DEEPEST if text == "None" else int(text),
                lambda value, sizes: "None" if value == DEEPEST else str(value))
#: A strength C weighs the sum over rows, regParam their mean.
STRENGTH = Setting("regParam", lambda text, sizes: 1.0 / (float(text) * max(sizes.rows, 1)),
                   lambda value, sizes: f"{1.0 / (value * max(sizes.rows, 1)):.10g}" if value else "inf")
PENALTY = Setting("elasticNetParam", lambda text, sizes: {"l1": 1.0, "l2": 0.0}[text],
                  lambda value, sizes: "l1" if value == 1.0 else "l2")
LAYERS = Setting("layers", _layers, lambda value, sizes: str(tuple(value[1:-1])))
SEEDED = _plain("seed", int)


@dataclass(frozen=True)
class Model:
    """A model: a new estimator, its settings, what is recommended with it and what is tried in tuning."""

    task: str
    name: str
    build: Callable[[Sizes], Estimator]
    settings: dict[str, Setting]
    recommended: dict[str, str]
    grid: dict[str, list[str]] = field(default_factory=dict)
    gradient: bool = False  # needs a label of unit scale


_TREES = {"n_estimators": ["50", "100", "200"], "max_depth": ["5", "10", "15", "None"], "min_samples_leaf": ["1", "2", "4"]}
_FOREST = {"n_estimators": _plain("numTrees", int), "max_depth": DEPTH, "min_samples_leaf": _plain("minInstancesPerNode", int),
           "random_state": SEEDED}
_STRENGTHS = ["0.1", "1.0", "10.0"]


def _svm(sizes: Sizes) -> Estimator:
    svm = LinearSVC(maxIter=100, standardization=False)
    return svm if sizes.n_classes == 2 else OneVsRest(classifier=svm)


# The parameters that go with each recommended model, and the values tried in tuning.
MODELS = {(m.task, m.name): m for m in [
    Model("classification", "Random Forest", lambda sizes: RandomForestClassifier(seed=SEED), _FOREST,
          {"model_type": "RandomForestClassifier", "n_estimators": "100", "max_depth": "10", "min_samples_split": "2",
           "min_samples_leaf": "1", "random_state": "42"}, _TREES),
    Model("classification", "Logistic Regression", lambda sizes: LogisticRegression(maxIter=1000, standardization=False),
          {"C": STRENGTH, "penalty": PENALTY, "max_iter": _plain("maxIter", int)},
          {"model_type": "LogisticRegression", "C": "1.0", "penalty": "l2", "solver": "lbfgs", "max_iter": "1000",
           "random_state": "42"}, {"C": _STRENGTHS, "penalty": ["l1", "l2"]}),
    Model("classification", "SVM", _svm, {"C": STRENGTH, "max_iter": _plain("maxIter", int)},
          {"model_type": "SVC", "C": "1.0", "kernel": "rbf", "gamma": "scale", "random_state": "42"}, {"C": _STRENGTHS}),
    Model("classification", "Neural Network",
          lambda sizes: MultilayerPerceptronClassifier(layers=_layers("(100, 50)", sizes), maxIter=500, seed=SEED),
          {"hidden_layer_sizes": LAYERS, "max_iter": _plain("maxIter", int), "random_state": SEEDED},
          {"model_type": "MLPClassifier", "hidden_layer_sizes": "(100, 50)", "activation": "relu", "solver": "adam",
           "alpha": "0.0001", "max_iter": "500", "random_state": "42"},
          {"hidden_layer_sizes": ["(50,)", "(100,)", "(50, 25)", "(100, 50)"]}),
    Model("regression", "Random Forest", lambda sizes: RandomForestRegressor(seed=SEED), _FOREST,
          {"model_type": "RandomForestRegressor", "n_estimators": "100", "max_depth": "10", "min_samples_split": "2",
           "min_samples_leaf": "1", "random_state": "42"}, _TREES),
    Model("regression", "Linear Regression", lambda sizes: LinearRegression(), {}, {"model_type": "LinearRegression"}),
    Model("regression", "Gradient-Boosted Trees", lambda sizes: GBTRegressor(seed=SEED),
          {"n_estimators": _plain("maxIter", int), "max_depth": DEPTH, "learning_rate": _plain("stepSize", float),
           "min_samples_leaf": _plain("minInstancesPerNode", int), "random_state": SEEDED},
          {"model_type": "GBTRegressor", "n_estimators": "20", "max_depth": "5", "learning_rate": "0.1",
           "min_samples_leaf": "1", "random_state": "42"},
          {"n_estimators": ["20", "50"], "max_depth": ["3", "5"], "learning_rate": ["0.05", "0.1"]}),
    Model("regression", "Factorization Machine", lambda sizes: FMRegressor(seed=SEED, stepSize=0.1),
          {"factor_size": _plain("factorSize", int), "learning_rate": _plain("stepSize", float),
           "alpha": _plain("regParam", float), "max_iter": _plain("maxIter", int), "random_state": SEEDED},
          {"model_type": "FMRegressor", "factor_size": "8", "learning_rate": "0.1", "alpha": "0.0", "max_iter": "100",
           "random_state": "42"}, {"factor_size": ["4", "8"], "alpha": ["0.0", "0.01"], "learning_rate": ["0.01", "0.1"]},
          gradient=True),
]}
#: Names that others give to models which MLlib lacks.
STAND_INS = {("regression", "SVR"): "Gradient-Boosted Trees", ("regression", "Neural Network"): "Factorization Machine"}


def find(task: str, name: str) -> Model:
    """The model of that name; a random forest for names that nobody knows."""
    known = STAND_INS.get((task, name), name)
    return MODELS.get((task, known)) or MODELS[task, "Random Forest"]


def names(task: str) -> list[str]:
    return [name for kind, name in MODELS if kind == task]


def _tuned(estimator: Estimator) -> Estimator:
    """What holds the parameters: of one-versus-rest, the classifier inside."""
    return estimator.getClassifier() if isinstance(estimator, OneVsRest) else estimator


def param_map(model: Model, estimator: Estimator, params: dict[str, str], sizes: Sizes) -> dict:
    """A text map as MLlib's own, for that estimator."""
    holder = _tuned(estimator)
    return {holder.getParam(s.param): s.read(params[n], sizes) for n, s in model.settings.items() if n in params}


def estimator(task: str, name: str, params: dict[str, str], sizes: Sizes) -> Estimator:
    """A new estimator with the parameters of a text map."""
    model = find(task, name)
    made = model.build(sizes)
    holder = _tuned(made)
    for param, value in param_map(model, made, params, sizes).items():
        holder.set(param, value)
    if isinstance(made, OneVsRest):
        made.setClassifier(holder)
    return made


def described(task: str, name: str, made: Estimator, sizes: Sizes) -> dict[str, str]:
    """The text map of an estimator, defaults included."""
    holder = _tuned(made)
    return {n: s.write(holder.getOrDefault(holder.getParam(s.param)), sizes)
            for n, s in find(task, name).settings.items() if holder.isDefined(holder.getParam(s.param))}


def grid(task: str, name: str) -> list[dict[str, str]]:
    """Every combination of the values to try; nothing for a model without any."""
    tried = find(task, name).grid
    return [dict(zip(tried, values)) for values in product(*tried.values())] if tried else []


def as_text(params: dict[str, str]) -> str:
    """A map as one text, equal maps as equal texts."""
    return json.dumps(params, sort_keys=True)


def from_text(text: str) -> dict[str, str]:
    return json.loads(text) if text else {}
