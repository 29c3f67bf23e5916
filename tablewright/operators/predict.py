"""Predictive analysis on MLlib: preparation, models, metrics, importance."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, RandomForestClassifier,
)
from pyspark.ml.feature import Interaction, OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.storagelevel import StorageLevel

from ..functions.columns import CATEGORICAL, NUMERIC, as_double, col, column_roles, pick, present, require, require_some
from ..functions.hashing import key_digest
from ..plans.quantiles import exact_quantiles
from ..plans.tall import fit_row
from .boosting import BINS, BoostedClasses, fit_classes
from .diagnose import CLASS_LIMIT

# Usual share of test rows, seed, forest size and boosting rounds.
TEST_SIZE, SEED, TREES, ROUNDS = 0.2, 42, 100, 100
DEPTHS = {"gradient_boosting": 3}   # others 5
CLASSES = 1000                      # most classes of a target, unless the caller names another number
REGRESSION, CLASSIFICATION = "regression", "classification"
MAX_FEATURE_LEVELS = 10_000   # string levels an indexer may hold on the driver
FIT_ROWS = 200_000            # training rows of a partition; a forest keeps some 500 bytes for each, and reads them in one piece


def complete_cases(df: DataFrame, target_column: str, columns="all", keys: Sequence[str] = ()) -> DataFrame:
    """Keys, target and features, rows with any missing target or feature dropped."""
    require(df, [target_column, *keys])
    names = [c for c in pick(df, columns) if c != target_column and c not in keys]
    require_some(names, "feature columns")
    return df.select(*[col(c) for c in dict.fromkeys([*keys, target_column, *names])]).dropna(
        subset=[target_column, *names]
    )


def is_test_row(keys: Sequence[str], test_size: float = TEST_SIZE, seed: int = SEED) -> Column:
    """True for a repeatable ``test_size`` share of rows: decided by each row's key, so
    it does not depend on partitioning, row order or retries."""
    return F.substring(key_digest(keys, seed), 1, 4) < F.lit(f"{round(test_size * 65536):04x}")


def split(df: DataFrame, keys: Sequence[str], test_size: float = TEST_SIZE, seed: int = SEED):
    """``(train, test)`` frames."""
    require(df, keys)
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1")
    test = is_test_row(keys, test_size, seed)
    return df.where(~test), df.where(test)


# --- preparation -----------------------------------------------------------------

@dataclass(frozen=True)
class Layout:
    """How features become a vector, learnt from training rows: per number its median
    (for missing values), mean and deviation; per string its sorted levels and the most
    frequent one; per hashed string its number of slots and the most frequent value. ``rows`` were seen."""

    numeric: dict[str, tuple[float, float, float]]
    text: dict[str, tuple[tuple[str, ...], str]]
    hashed: dict[str, tuple[int, str]] = field(default_factory=dict)
    rows: int = 0


def learn_layout(train: DataFrame, names: Sequence[str], hash_slots: dict[str, int] | int | None = None) -> Layout:
    """A fixed number of scans whatever the number of features: one aggregation for all
    columns, one count of ``(column, level)`` for all strings, which must stay few enough
    to become vector slots, and the narrowing scans of the exact medians.

    ``hash_slots`` (a number for all strings, or one per named column) hashes strings into that
    many slots instead: any number of levels, of which only the most frequent one is fetched."""
    roles = column_roles(train)
    numeric = [c for c in names if roles[c] == NUMERIC]
    text = [c for c in names if roles[c] == CATEGORICAL]
    require_some([*numeric, *text], "feature columns")
    slots = dict.fromkeys(text, hash_slots) if isinstance(hash_slots, int) else dict(hash_slots or {})
    if bad := [c for c, n in slots.items() if c not in text or n < 2]:
        raise ValueError(f"hash_slots needs text features and at least 2 slots: {', '.join(bad)}")
    hashing = [c for c in text if c in slots]
    text = [c for c in text if c not in slots]
    row = fit_row(train, {"rows": F.count(F.lit(1))} | {
        f"{k}{i}": e for i, c in enumerate(numeric) for k, e in (
            ("m", F.avg(as_double(train, c))), ("s", F.stddev_samp(as_double(train, c))))
    } | {f"d{i}": F.approx_count_distinct(present(train, c)) for i, c in enumerate(text)})
    if not row["rows"]:
        raise ValueError("no training rows left after dropping missing values")
    wide = [c for i, c in enumerate(text) if row[f"d{i}"] > MAX_FEATURE_LEVELS]
    if wide:
        raise ValueError(f"too many distinct values for a slot each (name hash_slots for them): {', '.join(wide)}")
    levels: dict[str, list] = {c: [] for c in text}
    if text:
        for r in _level_counts(train, text).collect():
            levels[r["column"]].append((r["level"], r["n"]))
    common = {}
    if hashing:
        first = F.min_by("level", F.struct((-F.col("n")).alias("n"), "level")).alias("level")
        common = {r["column"]: r["level"] for r in _level_counts(train, hashing).groupBy("column").agg(first).collect()}
    medians = exact_quantiles(train, numeric, [0.5])
    return Layout(
        {c: (medians[c][0], row[f"m{i}"], row[f"s{i}"] or 1.0) for i, c in enumerate(numeric)},
        {c: (tuple(sorted(v for v, _ in found)), min(found, key=lambda x: (-x[1], x[0]))[0]) for c, found in levels.items()},
        {c: (slots[c], common.get(c, "")) for c in hashing}, row["rows"],
    )


def _level_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(column, level, n)`` of several string columns in one scan."""
    values = df.select(*[present(df, c).alias(c) for c in names]).unpivot([], [col(c) for c in names], "column", "level")
    return values.where("level is not null").groupBy("column", "level").agg(F.count(F.lit(1)).alias("n"))


def _typed(df: DataFrame, layout: Layout) -> DataFrame:
    """Features under fixed inner names: filled and standardised numbers, filled strings."""
    out = {}
    for i, (c, (median, mean, std)) in enumerate(layout.numeric.items()):
        out[f"__x{i}"] = (F.coalesce(as_double(df, c), F.lit(median)) - F.lit(mean)) / F.lit(std)
    for i, (c, (_, common)) in enumerate(layout.text.items()):
        out[f"__s{i}"] = F.coalesce(present(df, c), F.lit(common))
    typed = df.withColumns(out)
    for i, (c, (slots, common)) in enumerate(layout.hashed.items()):
        value = F.coalesce(present(df, c), F.lit(common))
        slot = F.pmod(F.xxhash64(F.lit(c), value), F.lit(slots)).cast("double")
        sign = F.xxhash64(value, F.lit(c)).bitwiseAND(F.lit(1)) * 2.0 - 1.0
        nominal = {"ml_attr": {"type": "nominal", "num_vals": slots, "name": f"__k{i}"}}   # known: no job counts them
        typed = typed.withColumn(f"__k{i}", slot).withMetadata(f"__k{i}", nominal).withColumn(f"__g{i}", sign)
    return typed


def _inner(layout: Layout) -> list[str]:
    """All columns that ``_typed`` and ``preparation`` add on the way."""
    return [f"__x{i}" for i in range(len(layout.numeric))] + [
        f"__s{i}{k}" for i in range(len(layout.text)) for k in ("", "c", "o")
    ] + [f"__{k}{i}" for i in range(len(layout.hashed)) for k in "kgov"]


def preparation(typed: DataFrame, layout: Layout, one_hot: bool = True) -> PipelineModel:
    """From ``_typed`` columns to ``features``: strings become sorted codes and, unless
    switched off, one slot per level. The dropped last slot belongs to values unseen in
    training, which so become zeros. Nothing is fitted on data here."""
    stages, parts = [], [f"__x{i}" for i in range(len(layout.numeric))]
    if layout.text:
        raw = [f"__s{i}" for i in range(len(layout.text))]
        codes, slots = [f"{c}c" for c in raw], [f"{c}o" for c in raw]
        stages += [
            StringIndexerModel.from_labels(list(levels), r, code, handleInvalid="keep")
            for r, code, (levels, _) in zip(raw, codes, layout.text.values())
        ]
        if one_hot:
            stages.append(OneHotEncoder(inputCols=codes, outputCols=slots, dropLast=True))
        parts += slots if one_hot else codes
    if layout.hashed:
        ids = range(len(layout.hashed))
        if one_hot:        # a slot holds +1 or -1, so levels that share it do not only add up
            stages.append(OneHotEncoder(inputCols=[f"__k{i}" for i in ids], outputCols=[f"__o{i}" for i in ids], dropLast=False))
            stages += [Interaction(inputCols=[f"__o{i}", f"__g{i}"], outputCol=f"__v{i}") for i in ids]
        parts += [f"__{'v' if one_hot else 'k'}{i}" for i in ids]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=parts, outputCol="features")]).fit(typed)


def prepare_features(df: DataFrame, layout: Layout, one_hot: bool = True) -> DataFrame:
    """Add the vector column ``features`` (stateless: also on a stream)."""
    typed = _typed(df, layout)
    return preparation(typed, layout, one_hot).transform(typed).drop(*_inner(layout))


def _slots(layout: Layout, one_hot: bool = True) -> list[str]:
    """Source column of every slot of the feature vector."""
    return list(layout.numeric) + [
        c for c, (levels, _) in layout.text.items() for _ in (levels if one_hot else (1,))
    ] + [c for c, (slots, _) in layout.hashed.items() for _ in range(slots if one_hot else 1)]


def _learner(problem_type: str, model_type: str, trees: int, rounds: int, depth: int, seed: int):
    shared = {"featuresCol": "features", "labelCol": "__label"}
    if problem_type == REGRESSION:
        if model_type == "random_forest":
            # every split sees all features, the usual choice for regression forests
            return RandomForestRegressor(
                numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="all", **shared
            )
        if model_type == "gradient_boosting":
            return GBTRegressor(maxIter=rounds, maxDepth=depth, seed=seed, **shared)
        if model_type == "linear_model":
            return LinearRegression(solver="auto", regParam=0.0, **shared)
    elif problem_type == CLASSIFICATION:
        if model_type == "random_forest":
            return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, **shared)
        if model_type == "gradient_boosting":
            return GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed, **shared)
        if model_type == "linear_model":
            return LogisticRegression(maxIter=1000, regParam=0.0, **shared)
    else:
        raise ValueError(f"unknown problem type: {problem_type}")
    raise ValueError(f"unknown model type: {model_type}")


# --- fitting ---------------------------------------------------------------------

def _dealt(ready: DataFrame, layout: Layout) -> DataFrame:
    """Training rows in even partitions of at most about ``FIT_ROWS``. How a table lies in files says little: one
    row group is one partition, however many rows it has."""
    return ready.repartition(-(-layout.rows // FIT_ROWS)) if layout.rows > FIT_ROWS else ready


@dataclass(frozen=True)
class Fitted:
    """A trained model with its lazy prediction table over the test rows."""

    problem_type: str
    target: str
    keys: tuple[str, ...]
    layout: Layout
    labels: tuple | None
    prepared: PipelineModel
    model: object
    predictions: DataFrame    # keys, features, actual, predicted

    def score(self, df: DataFrame) -> DataFrame:
        """Predict any frame with the feature columns (stateless: also a stream)."""
        ready = self.prepared.transform(_typed(df, self.layout))
        out = self.model.transform(ready)
        kept = [col(c) for c in df.columns]
        if self.labels is None:
            return out.select(*kept, F.col("prediction").alias("predicted"))
        names = F.array(*[F.lit(v) for v in self.labels])
        return out.select(*kept, names[F.col("prediction").cast("int")].alias("predicted"))

    def metrics(self) -> DataFrame:
        if self.problem_type == REGRESSION:
            return regression_metrics(self.predictions)
        return classification_metrics(self.predictions, labels=self.labels)

    def importance(self) -> DataFrame:
        return model_importance(self)

    def sample(self, rows: int = 10, seed: int = SEED) -> DataFrame:
        return sample_predictions(self.predictions, self.keys, rows, seed)


def fit_model(
    df: DataFrame, target_column: str, keys: Sequence[str], columns="all", problem_type: str = REGRESSION,
    model_type: str = "random_forest", test_size: float = TEST_SIZE, seed: int = SEED, trees: int = TREES,
    rounds: int = ROUNDS, depth: int | None = None, max_classes: int = CLASSES,
    hash_slots: dict[str, int] | int | None = None,
) -> Fitted:
    """Train on the rows outside the test share and predict the test rows. Trees are 5 deep, boosted ones
    3, unless ``depth`` says otherwise; a target of more than ``max_classes`` classes is an error. Boosting with more than two classes
    grows a tree per class and round on one softmax. ``hash_slots``: see ``learn_layout``.

    ``keys`` identify a row; they decide the split and never enter the model. The
    prepared training rows are persisted only while the model is fitted.
    """
    data = complete_cases(df, target_column, columns, keys)
    features = [c for c in data.columns if c != target_column and c not in keys]
    train, test = split(data, keys, test_size, seed)
    layout = learn_layout(train, features, hash_slots)
    labels = None
    if problem_type == CLASSIFICATION:
        found = train.select(present(data, target_column).alias("v")).where("v is not null").distinct()
        labels = tuple(sorted(r["v"] for r in found.limit(max_classes + 1).collect()))
        if not 2 <= len(labels) <= max_classes:
            raise ValueError(f"classification needs between 2 and {max_classes} classes")
        values = F.array(*[F.lit(v) for v in labels])
        label = (F.array_position(values, col(target_column)) - 1).cast("double")
    else:
        label = as_double(data, target_column)
    typed = _typed(train.withColumn("__label", label), layout)
    deep = DEPTHS.get(model_type, 5) if depth is None else depth
    many = len(labels or ()) > 2 and model_type == "gradient_boosting"
    prepared = preparation(typed, layout, one_hot=not many)
    ready = prepared.transform(typed).select("features", "__label")
    if model_type != "linear_model":      # those keep nothing besides the rows
        ready = _dealt(ready, layout)
    ready.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if many:
            sizes = [len(v) for v, _ in layout.text.values()] + [n for n, _ in layout.hashed.values()]
            model = fit_classes(ready, len(labels), _thresholds(train, layout), sizes, rounds, deep)
        else:
            model = _learner(problem_type, model_type, trees, rounds, deep, seed).fit(ready)
    finally:
        ready.unpersist()
    fitted = Fitted(problem_type, target_column, tuple(keys), layout, labels, prepared, model, None)
    scored = fitted.score(test)
    table = scored.select(
        *[col(k) for k in keys], *[col(c) for c in (*layout.numeric, *layout.text, *layout.hashed)],
        col(target_column).alias("actual"), "predicted",
    )
    return Fitted(problem_type, target_column, tuple(keys), layout, labels, prepared, model, table)


def _thresholds(train: DataFrame, layout: Layout) -> list[list[float]]:
    """Quantiles of every number, on the standardised scale, that part it into codes."""
    found = exact_quantiles(train, list(layout.numeric), [i / BINS for i in range(BINS)])
    return [[(q - mean) / std for q in found[c] if q is not None] for c, (_, mean, std) in layout.numeric.items()]


# --- results ---------------------------------------------------------------------

def regression_metrics(predictions: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """One row ``(n, mse, rmse, r2)``."""
    y, p = as_double(predictions, actual), as_double(predictions, predicted)
    error = (y - p) * (y - p)
    return predictions.agg(
        F.count(error).alias("n"), F.avg(error).alias("mse"), F.sqrt(F.avg(error)).alias("rmse"),
        (1 - F.try_divide(F.avg(error), F.var_pop(y))).alias("r2"),
    )


def confusion(predictions: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """``(actual, predicted, n)``."""
    return predictions.groupBy(col(actual).alias("actual"), col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def classification_metrics(
    predictions: DataFrame, actual: str = "actual", predicted: str = "predicted", positive=None, labels: Sequence | None = None,
) -> DataFrame:
    """One row ``(n, classes, accuracy, precision, recall, f1)``.

    Two classes: precision, recall and F1 of ``positive`` (the larger label unless
    given). More: averages over the classes weighted by their true size. ``labels``, the sorted
    classes of the model, decide both where the rows at hand lack some. The data is
    reduced to the confusion table first.
    """
    if positive is None and labels is not None and len(labels) == 2:
        positive = labels[-1]
    cells = confusion(predictions, actual, predicted)
    sides = cells.select(F.inline(F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("truth"), F.lit(0).cast("long").alias("called"),
                 F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("truth"), F.col("n").alias("called"),
                 F.lit(0).cast("long").alias("hit")),
    )))
    label = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("truth", "called", "hit")])
    p = F.coalesce(F.try_divide(F.col("hit"), F.col("called")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("hit"), F.col("truth")), F.lit(0.0))
    each = label.select("label", "truth", "hit", p.alias("p"), r.alias("r")).withColumn(
        "f", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0))
    )
    chosen = F.max("label") if positive is None else F.lit(positive)
    row = each.agg(
        F.sum("truth").alias("n"), F.count(F.lit(1)).alias("classes"),
        F.try_divide(F.sum("hit"), F.sum("truth")).alias("accuracy"), chosen.alias("positive"),
        *[F.try_divide(F.sum(F.col("truth") * F.col(c)), F.sum("truth")).alias(f"{c}_all") for c in "prf"],
        *([F.max_by(c, "label").alias(f"{c}_one") for c in "prf"] if positive is None else
          [F.coalesce(F.max(F.when(F.col("label") == F.lit(positive), F.col(c))), F.lit(0.0)).alias(f"{c}_one") for c in "prf"]),
    )
    many = F.lit(len(labels) > 2) if labels is not None else F.col("classes") > 2
    return row.select("n", "classes", "accuracy", *[
        F.when(many, F.col(f"{c}_all")).otherwise(F.col(f"{c}_one")).alias(name)
        for c, name in zip("prf", ("precision", "recall", "f1"))
    ])


def model_importance(fitted: Fitted) -> DataFrame:
    """``(feature, importance, place)``, slots of one-hot features added up. Trees give
    impurity importances, linear models absolute coefficients (averaged over classes)."""
    model = fitted.model
    spark = fitted.predictions.sparkSession
    if isinstance(model, BoostedClasses):
        return _ranked(spark, _slots(fitted.layout, one_hot=False), model.gains)
    if hasattr(model, "featureImportances"):
        found = model.featureImportances.toArray()
    elif getattr(model, "numClasses", 2) > 2:
        found = abs(model.coefficientMatrix.toArray()).mean(axis=0)
    else:
        found = abs(model.coefficients.toArray())
    return _ranked(spark, _slots(fitted.layout), found)


def _ranked(spark, slots: Sequence[str], weights: Sequence[float]) -> DataFrame:
    total: dict[str, float] = {}
    for c, w in zip(slots, weights):
        total[c] = total.get(c, 0.0) + float(w)
    order = sorted(total.items(), key=lambda kv: (-kv[1], kv[0]))
    return spark.createDataFrame(
        [(c, w, i + 1) for i, (c, w) in enumerate(order)], "feature string, importance double, place int"
    )


def sample_predictions(predictions: DataFrame, keys: Sequence[str], rows: int = 10, seed: int = SEED) -> DataFrame:
    """A repeatable random handful of test rows with features, actual and predicted."""
    return predictions.withColumn("__h", key_digest(keys, seed)).orderBy("__h").limit(rows).drop("__h")


def forest_importance(df: DataFrame, target_column: str, columns, trees: int, depth: int, seed: int) -> DataFrame:
    """Random-forest importance over all complete rows; strings enter as sorted codes."""
    data = complete_cases(df, target_column, columns)
    layout = learn_layout(data, [c for c in data.columns if c != target_column])
    text = column_roles(data)[target_column] != NUMERIC
    kinds = data.agg(F.approx_count_distinct(present(data, target_column))).first()[0]
    if not text and kinds < 2 * CLASS_LIMIT:      # close to the limit: count exactly
        kinds = data.agg(F.count_distinct(present(data, target_column))).first()[0]
    classify = text or kinds < CLASS_LIMIT
    if classify:
        data = data.withColumn("__target", col(target_column).cast("string"))
        names = sorted(r[0] for r in data.select("__target").distinct().limit(CLASSES + 1).collect())
        if len(names) > CLASSES:
            raise ValueError(f"a forest needs at most {CLASSES} classes")
        data = StringIndexerModel.from_labels(names, "__target", "__label").transform(data)
    else:
        data = data.withColumn("__label", as_double(data, target_column))
    typed = _typed(data, layout)
    prepared = preparation(typed, layout, one_hot=False)
    ready = _dealt(prepared.transform(typed).select("features", "__label"), layout).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        learner = _learner(CLASSIFICATION if classify else REGRESSION, "random_forest", trees, 0, depth, seed)
        if layout.text:
            learner = learner.setMaxBins(max(32, 1 + max(len(levels) for levels, _ in layout.text.values())))
        model = learner.fit(ready)
    finally:
        ready.unpersist()
    slots = _slots(layout, one_hot=False)
    return _ranked(df.sparkSession, slots, model.featureImportances.toArray())


def predict(
    df: DataFrame, target_column: str, keys: Sequence[str], columns="all", problem_type: str = REGRESSION,
    model_type: str = "random_forest", test_size: float = TEST_SIZE, **options,
) -> dict[str, DataFrame]:
    """All blocks of the predictive analysis, keyed by block name."""
    fitted = fit_model(df, target_column, keys, columns, problem_type, model_type, test_size, **options)
    return {
        "model_performance": fitted.metrics(), "feature_importance": fitted.importance(),
        "predictions_sample": fitted.sample(),
    }
