"""Predictive analysis. Metrics, preparation and least squares are checked against SQL. Forests, boosting and
logistic models have no SQL; their queries return all rows, and tests hold them against hand-computed trees."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import predict
from .registry import DOCS_LABELS_SQL, EVENTS_GAP_SQL, docs_labels, events_gap, query, table, tidy, tidy_sql

ORDER_FEATURES = ["o_custkey", "o_orderstatus", "o_orderpriority"]


@query("complete_cases", f"SELECT doc_id, quality, n_chars, lang FROM {DOCS_LABELS_SQL} t WHERE quality IS NOT NULL")
def complete_cases(spark, folder):
    return predict.complete_cases(docs_labels(spark, folder), "quality", ["n_chars", "lang"], ["doc_id"])


@query("split", "SELECT o_orderkey, substr(md5('42:' || o_orderkey::varchar), 1, 4) < '3333' AS is_test FROM orders")
def split(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", predict.is_test_row(["o_orderkey"]).alias("is_test"))


_TRAIN = "(SELECT * FROM {0} t WHERE substr(md5('42:' || event_id::varchar), 1, 4) >= '3333')".format(EVENTS_GAP_SQL)


@query("numeric_preparation", tidy_sql(
    "SELECT event_id, (coalesce(value, q) - m) / s AS value, (user_id - um) / us AS user_id FROM {0} t,"
    " (SELECT quantile_cont(value, 0.5) AS q, avg(value) AS m, stddev_samp(value) AS s, avg(user_id) AS um, stddev_samp(user_id) AS us"
    " FROM {1} t) f".format(EVENTS_GAP_SQL, _TRAIN), "value", "user_id"
))
def numeric_preparation(spark, folder):
    """Median fill and standardising, learnt on the training share, applied to all rows."""
    events = events_gap(spark, folder)
    layout = predict.learn_layout(predict.split(events, ["event_id"])[0], ["value", "user_id"])
    slots = vector_to_array(F.col("features"))
    return tidy(predict.prepare_features(events, layout).select(
        "event_id", slots[0].alias("value"), slots[1].alias("user_id")
    ))


_PRIORITY = "(SELECT o_orderkey, nullif(o_orderpriority, '2-HIGH') AS p FROM orders)"


@query("categorical_preparation", (
    "SELECT o_orderkey, " + ", ".join(
        f"(coalesce(p, common) = '{v}')::INT AS level_{i}" for i, v in enumerate(("1-URGENT", "3-MEDIUM", "4-NOT SPECIFIED"))
    ) + f" FROM {_PRIORITY} t, (SELECT p AS common FROM {_PRIORITY} u WHERE p <> '5-LOW' GROUP BY p ORDER BY count(*) DESC, p LIMIT 1) c"
))
def categorical_preparation(spark, folder):
    """Most frequent value for a missing one, a slot per level, none for an unseen level."""
    priority = F.nullif(F.col("o_orderpriority"), F.lit("2-HIGH")).alias("p")
    orders = table(spark, folder, "orders").select("o_orderkey", priority)
    layout = predict.learn_layout(orders.where("p <> '5-LOW'"), ["p"])
    slots = vector_to_array(F.col("features"))
    return predict.prepare_features(orders, layout).select(
        "o_orderkey", *[slots[i].cast("int").alias(f"level_{i}") for i in range(3)]
    )


@query("regression_metrics", tidy_sql(
    "SELECT n, mse, sqrt(mse) AS rmse, 1 - mse / v AS r2 FROM (SELECT count(*) AS n, avg((y - p) * (y - p)) AS mse, var_pop(y) AS v"
    " FROM (SELECT l_extendedprice / 1000 AS y, l_quantity * 1.5 AS p FROM lineitem) t) t", "mse", "rmse", "r2"
))
def regression_metrics(spark, folder):
    guess = table(spark, folder, "lineitem").select(
        (F.col("l_extendedprice") / 1000).alias("actual"), (F.col("l_quantity") * 1.5).alias("predicted")
    )
    return tidy(predict.regression_metrics(guess))


_MANY = "(SELECT o_orderstatus AS y, CASE WHEN o_totalprice > 400000 THEN 'P' WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'O' END AS p FROM orders)"


@query("classification_metrics", tidy_sql(
    "SELECT sum(t)::BIGINT AS n, count(*) AS classes, sum(h)::double / sum(t) AS accuracy, sum(t * pr)::double / sum(t) AS precision,"
    " sum(t * re)::double / sum(t) AS recall, sum(t * CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END) / sum(t) AS f1 FROM ("
    "SELECT *, CASE WHEN c > 0 THEN h::double / c ELSE 0 END AS pr, CASE WHEN t > 0 THEN h::double / t ELSE 0 END AS re FROM ("
    "SELECT l, (SELECT count(*) FROM {0} a WHERE y = l) AS t, (SELECT count(*) FROM {0} a WHERE p = l) AS c,"
    " (SELECT count(*) FROM {0} a WHERE y = l AND p = l) AS h FROM (SELECT y AS l FROM {0} a UNION SELECT p FROM {0} a) l) x) x".format(_MANY),
    "accuracy", "precision", "recall", "f1"
))
def classification_metrics(spark, folder):
    called = F.when(F.col("o_totalprice") > 400000, "P").when(F.col("o_custkey") % 2 == 0, "F").otherwise("O")
    orders = table(spark, folder, "orders").select(F.col("o_orderstatus").alias("actual"), called.alias("predicted"))
    return tidy(predict.classification_metrics(orders))


@query("classification_metrics_two", tidy_sql(
    "SELECT n, 2::BIGINT AS classes, ok::double / n AS accuracy, pr AS precision, re AS recall, 2 * pr * re / (pr + re) AS f1 FROM ("
    "SELECT count(*) AS n, count(*) FILTER (y = p) AS ok, (count(*) FILTER (y = 1 AND p = 1))::double / count(*) FILTER (p = 1) AS pr,"
    " (count(*) FILTER (y = 1 AND p = 1))::double / count(*) FILTER (y = 1) AS re FROM (SELECT quality AS y, (n_chars > 1000)::int AS p"
    f" FROM {DOCS_LABELS_SQL} t WHERE quality IS NOT NULL) t) t", "accuracy", "precision", "recall", "f1"
))
def classification_metrics_two(spark, folder):
    docs = docs_labels(spark, folder).where("quality is not null")
    return tidy(predict.classification_metrics(docs.select(
        F.col("quality").alias("actual"), (F.col("n_chars") > 1000).cast("int").alias("predicted")
    )))


def _orders_model(spark, folder, kind, **options):
    return predict.fit_model(
        table(spark, folder, "orders"), "o_totalprice", ["o_orderkey"], ORDER_FEATURES, "regression", kind, **options
    )


def _quality_model(spark, folder, kind, **options):
    return predict.fit_model(
        docs_labels(spark, folder), "quality", ["doc_id"], ["n_chars", "lang", "source"], "classification", kind, **options
    )


@query("forest_regression")
def forest_regression(spark, folder):
    return _orders_model(spark, folder, "random_forest").metrics()


@query("boosted_regression")
def boosted_regression(spark, folder):
    return _orders_model(spark, folder, "gradient_boosting").metrics()


@query("linear_regression")
def linear_regression(spark, folder):
    return _orders_model(spark, folder, "linear_model").metrics()


_PART = "(SELECT p_size::double AS x, p_retailprice AS y, substr(md5('42:' || p_partkey::varchar), 1, 4) < '3333' AS test FROM part)"


@query("linear_regression_one_feature", tidy_sql(
    "SELECT n, mse, sqrt(mse) AS rmse, 1 - mse / v AS r2 FROM (SELECT count(*) AS n, avg(pow(y - (b + a * x), 2)) AS mse, var_pop(y) AS v"
    f" FROM {_PART} t, (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM {_PART} u WHERE NOT test) m WHERE test) t",
    "mse", "rmse", "r2", digits=4
))
def linear_regression_one_feature(spark, folder):
    """Split, preparation, model and metrics from end to end; scaling cancels out."""
    fitted = predict.fit_model(
        table(spark, folder, "part"), "p_retailprice", ["p_partkey"], ["p_size"], "regression", "linear_model"
    )
    return tidy(fitted.metrics(), 4)


@query("forest_classification")
def forest_classification(spark, folder):
    return _quality_model(spark, folder, "random_forest").metrics()


@query("boosted_classification")
def boosted_classification(spark, folder):
    return _quality_model(spark, folder, "gradient_boosting").metrics()


@query("boosted_classification_many")
def boosted_classification_many(spark, folder):
    return predict.fit_model(
        table(spark, folder, "orders"), "o_orderstatus", ["o_orderkey"], ["o_totalprice", "o_orderpriority"],
        "classification", "gradient_boosting",
    ).metrics()


@query("logistic_regression")
def logistic_regression(spark, folder):
    return _quality_model(spark, folder, "linear_model").metrics()


@query("tree_importance")
def tree_importance(spark, folder):
    return _orders_model(spark, folder, "random_forest").importance()


@query("linear_importance")
def linear_importance(spark, folder):
    return predict.fit_model(
        table(spark, folder, "orders"), "o_orderstatus", ["o_orderkey"], ["o_totalprice", "o_orderpriority"],
        "classification", "linear_model",
    ).importance()


# Two standardised features: the normal equations are two equations in covariances.
_TWO = (
    "(SELECT l_quantity::double AS a, l_discount::double AS b, l_extendedprice::double AS y,"
    " substr(md5('42:' || l_orderkey::varchar || ':' || l_linenumber::varchar), 1, 4) < '3333' AS test FROM lineitem)"
)
_COEFFICIENTS = (
    "(SELECT (say * bb - sby * ab) / (aa * bb - ab * ab) AS ca, (sby * aa - say * ab) / (aa * bb - ab * ab) AS cb, sa, sb, ma, mb, my FROM ("
    "SELECT covar_pop(y, a) AS say, covar_pop(y, b) AS sby, covar_pop(a, b) AS ab, var_pop(a) AS aa, var_pop(b) AS bb,"
    f" stddev_samp(a) AS sa, stddev_samp(b) AS sb, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM {_TWO} t WHERE NOT test) t)"
)


def _price_model(spark, folder):
    return predict.fit_model(
        table(spark, folder, "lineitem"), "l_extendedprice", ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount"],
        "regression", "linear_model",
    )


@query("linear_importance_two_features", tidy_sql(
    "SELECT feature, importance, row_number() OVER (ORDER BY importance DESC, feature)::INT AS place FROM ("
    f"SELECT 'l_quantity' AS feature, abs(ca * sa) AS importance FROM {_COEFFICIENTS} c"
    f" UNION ALL SELECT 'l_discount', abs(cb * sb) FROM {_COEFFICIENTS} c) t", "importance", digits=3
))
def linear_importance_two_features(spark, folder):
    return tidy(_price_model(spark, folder).importance(), 3)


@query("linear_predictions_two_features", tidy_sql(
    f"SELECT a AS l_quantity, b AS l_discount, y AS actual, my + ca * (a - ma) + cb * (b - mb) AS predicted"
    f" FROM {_TWO} t, {_COEFFICIENTS} c WHERE test", "l_quantity", "l_discount", "actual", "predicted", digits=2
))
def linear_predictions_two_features(spark, folder):
    """Every prediction of the test rows."""
    return tidy(_price_model(spark, folder).predictions.drop("l_orderkey", "l_linenumber"), 2)


@query("hashed_features_classification")
def hashed_features_classification(spark, folder):
    """A feature with a level per customer, hashed into 256 signed slots."""
    return predict.fit_model(
        table(spark, folder, "orders").withColumn("customer", F.concat(F.lit("c"), F.col("o_custkey").cast("string"))),
        "o_orderstatus", ["o_orderkey"], ["customer", "o_totalprice"], "classification", "linear_model", hash_slots={"customer": 256},
    ).metrics()


@query("sample_predictions")
def sample_predictions(spark, folder):
    return _quality_model(spark, folder, "random_forest").sample()


@query("sample_predictions_rule", (
    "SELECT doc_id, quality AS actual, (n_chars > 1000)::int AS predicted FROM (SELECT * FROM " + DOCS_LABELS_SQL +
    " t WHERE quality IS NOT NULL) t ORDER BY md5('42:' || doc_id::varchar) LIMIT 10"
))
def sample_predictions_rule(spark, folder):
    docs = docs_labels(spark, folder).where("quality is not null")
    table_ = docs.select("doc_id", F.col("quality").alias("actual"), (F.col("n_chars") > 1000).cast("int").alias("predicted"))
    return predict.sample_predictions(table_, ["doc_id"])
