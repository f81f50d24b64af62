"""Registered queries: model preparation, metrics and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from factsieve.catalog.inputs import WITH_BASE, WITH_DIRTY, WITH_SCORED, dirty_base, dirty_orders, scored, table
from factsieve.catalog.profile_queries import DIRTY, role_sql
from factsieve.catalog.shape import rounded, union_sql
from factsieve.operators import metrics, ml, splits
from factsieve.operators.features import Features
from factsieve.operators.linear import fold_scores
from factsieve.operators.neighbors import knn_predict
from factsieve.plans.store import new_path

PREPARED = ["o_totalprice", "o_orderdate", "o_orderstatus", "is_gift"]


def vectors(s, d):
    """embeddings with the array spread over columns."""
    e = table(s, d, "embeddings")
    width = e.agg(F.max(F.size("embedding"))).first()[0] or 0  # of the longest, so that no vector loses its tail
    return e.select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i:03d}") for i in range(width)])


def q_features(s, d):
    base = dirty_base(s, d)
    return rounded(Features.fit(base, PREPARED).table(base, ["o_orderkey"]))


def q_knn(s, d):
    data = splits.split(vectors(s, d), ["vec_id"], 0.2, "label")
    names = [c for c in data.columns if c.startswith("e")]
    found = knn_predict(data.where("not is_test"), data.where("is_test"), names, "label", ["vec_id"])
    return found.select(F.col("id").cast("long").alias("vec_id"), "prediction")


def prices(s, d):
    return table(s, d, "part").select("p_partkey", "p_size", "p_brand", "p_type", "p_retailprice")


def segments(s, d):
    return table(s, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")


def guard(s, d):
    base, rows = dirty_base(s, d), []
    for target, task in [("o_totalprice", "regression"), ("o_orderdate", "regression"), ("raw_date", "classification"),
                         ("currency", "classification"), ("o_orderpriority", "classification"), ("nope", "regression"),
                         ("is_gift", "regression"), ("o_custkey", "classification")]:
        try:
            n, classes = ml.check_target(base, target, task)
            rows.append((target, task, n, len(classes), "ok"))
        except ValueError as e:
            rows.append((target, task, None, None, str(e)))
    return s.createDataFrame(rows, "target string, task string, n bigint, classes bigint, outcome string")


def q_regression(s, d):
    return ml.train_models(prices(s, d), "p_retailprice", "regression", ["p_partkey"], cv=0).results


def q_classification(s, d):
    return ml.train_models(segments(s, d), "c_mktsegment", "classification", ["c_custkey"], cv=0).results


def q_compare(s, d):
    return ml.train_models(vectors(s, d), "label", "classification", ["vec_id"], models=["logistic", "knn", "decision_tree"]).results


def q_boosting(s, d):
    """Boosted trees of two classes, scored on all events."""
    data = table(s, d, "events").select("event_id", "user_id", "value", (F.col("event_type") == "purchase").alias("bought"))
    return ml.train_models(data, "bought", "classification", ["event_id"], models=["gradient_boosting"], cv=0).results


def lines(s, d):
    return table(s, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_key"), "l_quantity", "l_discount", "l_tax",
        "l_returnflag", "l_shipdate", "l_extendedprice")


def q_cv(s, d):
    return ml.train_models(lines(s, d), "l_extendedprice", "regression", ["row_key"], models=["linear"]).results


def q_linear_folds(s, d):
    folded = splits.folds(lines(s, d), ["row_key"])
    return rounded(fold_scores(folded, "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_shipdate"], 5).select(
        "fold", "n_train", "n_test", "rmse", "r2"), 4)


def q_importance(s, d):
    run = ml.train_models(prices(s, d), "p_retailprice", "regression", ["p_partkey"], models=["random_forest"], cv=0)
    return ml.importance_table(s, run.best_model)


def q_batch_predict(s, d):
    data = table(s, d, "events").select("event_id", "user_id", "value", (F.col("event_type") == "purchase").alias("bought"))
    run = ml.train_models(data, "bought", "classification", ["event_id"], models=["logistic"], cv=0)
    path = run.best_model.save(s, new_path(s, "model"))
    loaded = ml.TrainedModel.load(s, path)
    return loaded.predict(data, ["event_id"]).select("event_id", "prediction", F.element_at("probabilities", F.lit("true")).alias("p_true"))


QUERIES = {
    "suggest_targets": lambda s, d: ml.suggest_targets(dirty_orders(s, d)),
    "ml_guard": guard,
    "ml_stratified_sample": lambda s, d: splits.stratified_sample(
        table(s, d, "events"), ["event_id"], 2000, "event_type").select("event_id", "event_type"),
    "ml_features": q_features,
    "ml_split": lambda s, d: splits.split(table(s, d, "events"), ["event_id"], 0.2, "event_type").select("event_id", "is_test"),
    "cv_folds": lambda s, d: splits.folds(table(s, d, "events"), ["event_id"], 5, "event_type").select(
        "event_id", F.col("fold").cast("long").alias("fold")),
    "regression_metrics": lambda s, d: rounded(metrics.regression_metrics(scored(s, d), "target", "guess")),
    "classification_metrics": lambda s, d: rounded(metrics.classification_metrics(scored(s, d), "label", "prediction")),
    "confusion_matrix": lambda s, d: metrics.confusion_matrix(scored(s, d), "label", "prediction"),
    "roc_auc": lambda s, d: rounded(metrics.roc_auc(scored(s, d), "y", "score")),
    "knn_predict": q_knn,
    "ml_regression": q_regression,
    "ml_classification": q_classification,
    "ml_cv": q_cv,
    "ml_linear_folds": q_linear_folds,
    "ml_compare": q_compare,
    "ml_boosting": q_boosting,
    "ml_importance": q_importance,
    "ml_batch_predict": q_batch_predict,
}


def hash_rank(seed: int, by: str = "event_type") -> str:
    return f"""SELECT event_id, event_type, rank() OVER (PARTITION BY {by} ORDER BY substr(md5(concat(event_id, '|{seed}')), 1, 13)) AS r,
  count(*) OVER (PARTITION BY {by}) AS n FROM events"""


def features_sql() -> str:
    number = lambda c, e: (f"(coalesce({e}, {c}_med) - {c}_mean) / {c}_std")
    day = "date_diff('day', DATE '0001-01-01', o_orderdate::DATE) + 1"
    return WITH_BASE + f""", med AS (SELECT median(o_totalprice) AS p_med, quantile_cont(({day})::DOUBLE, 0.5) AS d_med,
  (SELECT o_orderstatus FROM base WHERE o_orderstatus IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mo FROM base),
st AS (SELECT avg(coalesce(o_totalprice, p_med)) AS p_mean, stddev_pop(coalesce(o_totalprice, p_med)) AS p_std,
  avg(({day})::DOUBLE) AS d_mean, stddev_pop(({day})::DOUBLE) AS d_std FROM base, med)
SELECT o_orderkey, round({number('p', 'o_totalprice')}, 6) AS o_totalprice, round({number('d', day)}, 6) AS o_orderdate,
  COLUMNS_HERE,
  CAST(is_gift AS INT)::DOUBLE AS is_gift_true, CAST(NOT is_gift AS INT)::DOUBLE AS is_gift_false FROM base, med, st"""


FACT_ROWS = WITH_DIRTY + ", roles AS (" + role_sql() + "), f AS (" + union_sql([
    f"""SELECT '{c}' AS "column", count(*) AS n, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS u,
  (SELECT max(k) FROM (SELECT count(*) AS k FROM dirty WHERE {c} IS NOT NULL GROUP BY {c})) AS top FROM dirty""" for c in DIRTY]) + ")"

KNN_SQL = """WITH s AS (SELECT vec_id, label, embedding, rank() OVER (PARTITION BY label ORDER BY substr(md5(concat(vec_id, '|42')), 1, 13)) <=
  round(count(*) OVER (PARTITION BY label) * 0.2) AS is_test FROM embeddings),
d AS (SELECT vec_id, label, is_test, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM s),
m AS (SELECT i, avg(v) AS mean, stddev_pop(v) AS std FROM d WHERE NOT is_test GROUP BY i),
z AS (SELECT vec_id, label, is_test, i, (v - mean) / std AS v FROM d JOIN m USING (i)),
p AS (SELECT a.vec_id, b.vec_id AS other, b.label::VARCHAR AS label, sum(pow(a.v - b.v, 2)) AS dist
  FROM z a JOIN z b ON a.i = b.i AND a.is_test AND NOT b.is_test GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, label) AS r FROM p),
v AS (SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id ORDER BY count(*) DESC, label) AS r FROM k WHERE r <= 5 GROUP BY vec_id, label)
SELECT vec_id, label AS prediction FROM v WHERE r = 1"""

# Normal equations of each fold's training rows, solved by sweeping one column after the other.
FOLDS_SQL = """WITH RECURSIVE h AS (SELECT l_extendedprice::DOUBLE AS p, l_quantity::DOUBLE AS q, l_discount::DOUBLE AS c, l_tax::DOUBLE AS t,
  date_diff('day', DATE '0001-01-01', l_shipdate::DATE)::DOUBLE AS d, l_returnflag AS f, count(*) OVER () AS n, rank() OVER (ORDER BY
  substr(md5(concat(concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey), '|42')), 1, 13)) AS r FROM lineitem),
m AS (SELECT avg(p) AS mp, avg(q) AS mq, avg(c) AS mc, avg(t) AS mt, avg(d) AS md, stddev_pop(d) AS sd, min(f) AS f1, max(f) AS f2 FROM h),
x AS (SELECT CAST(((r - 1) * 5) // n AS INT) AS fold, [1, q - mq, c - mc, t - mt, (d - md) / sd, CAST(f = f1 AS INT), CAST(f = f2 AS INT), p - mp]::DOUBLE[] AS x
  FROM h, m),
g AS (SELECT fold, i, j, sum(x[i] * x[j]) AS s FROM x, range(1, 9) a(i), range(1, 9) b(j) GROUP BY ALL),
w AS (SELECT o.fold, o.i, o.j, a.s - o.s AS s FROM g o JOIN (SELECT i, j, sum(s) AS s FROM g GROUP BY ALL) a USING (i, j)),
rows AS (SELECT fold, i, list(s ORDER BY j) AS row FROM w GROUP BY ALL),
sweep AS (SELECT fold, 1 AS k, list(row ORDER BY i) AS a FROM rows GROUP BY fold UNION ALL
  SELECT fold, k + 1, [CASE WHEN i = k THEN [v / a[k][k] FOR v IN a[k]] ELSE [a[i][j] - a[i][k] * a[k][j] / a[k][k] FOR j IN range(1, 9)] END FOR i IN range(1, 9)]
  FROM sweep WHERE k <= 7),
b AS (SELECT fold, [a[i][8] FOR i IN range(1, 8)] AS b FROM sweep WHERE k = 8),
e AS (SELECT fold, x[8] AS y, x[8] - list_dot_product(x[1:7], b) AS e FROM x JOIN b USING (fold))
SELECT fold, CAST((SELECT count(*) FROM x) - count(*) AS BIGINT) AS n_train, count(*) AS n_test, round(sqrt(avg(e * e)), 4) AS rmse,
  round(1 - avg(e * e) / var_pop(y), 4) AS r2 FROM e GROUP BY fold"""


def refused(target: str, task: str, outcome: str) -> str:
    text = outcome.replace("'", "''")
    return f"SELECT '{target}' AS target, '{task}' AS task, NULL::BIGINT AS n, NULL::BIGINT AS classes, '{text}' AS outcome"


GUARD_SQL = WITH_BASE + union_sql([
    "SELECT 'o_totalprice' AS target, 'regression' AS task, count(o_totalprice) AS n, 0::BIGINT AS classes, 'ok' AS outcome FROM base",
    "SELECT 'o_orderpriority', 'classification', count(o_orderpriority), count(DISTINCT o_orderpriority), 'ok' FROM base",
    refused("o_orderdate", "regression", "'o_orderdate' has the role datetime, models learn numbers and labels"),
    refused("raw_date", "classification", "'raw_date' has the role datetime, models learn numbers and labels"),
    refused("currency", "classification", "'currency' has one label only"),
    refused("nope", "regression", "the table has no column 'nope' to learn"),
    refused("is_gift", "regression", "'is_gift' takes fewer than 5 values, learn it as labels"),
    refused("o_custkey", "classification", "'o_custkey' has over 20 labels")])

ORACLE = {
    "ml_guard": GUARD_SQL,
    "suggest_targets": FACT_ROWS + """, c AS (SELECT *, missing * 100.0::DOUBLE / n AS pct, CASE
  WHEN role = 'numeric' AND u < 5 THEN 'few_values' WHEN role = 'numeric' AND missing * 100.0 / n > 30 THEN 'too_many_missing'
  WHEN role = 'numeric' THEN 'continuous' WHEN role NOT IN ('categorical', 'boolean') THEN 'not_a_target' WHEN u < 2 THEN 'one_class'
  WHEN u > 20 THEN 'too_many_classes' WHEN u = n THEN 'identifier' WHEN top * 100.0 / (n - missing) >= 70 THEN 'classes_imbalanced'
  ELSE 'classes' END AS reason FROM f JOIN roles USING ("column"))
SELECT "column", CASE WHEN reason = 'few_values' THEN 'classification?' WHEN role = 'numeric' THEN 'regression'
  WHEN role IN ('categorical', 'boolean') THEN 'classification' ELSE 'none' END AS task,
  reason IN ('continuous', 'classes', 'classes_imbalanced') AS suitable, reason, u AS "unique", round(pct, 1) AS missing_pct,
  CASE reason WHEN 'few_values' THEN 0.2 WHEN 'too_many_missing' THEN 0.3 WHEN 'continuous' THEN CASE WHEN u > 20 THEN 0.9 ELSE 0.7 END
    WHEN 'too_many_classes' THEN 0.2 WHEN 'classes' THEN 0.85 WHEN 'classes_imbalanced' THEN 0.85 ELSE 0.0 END::DOUBLE AS score FROM c""",
    "ml_stratified_sample": f"SELECT event_id, event_type FROM ({hash_rank(42)}) WHERE r <= greatest(1, floor(n * 2000 / (SELECT count(*) FROM events)))",
    "ml_features": features_sql().replace("COLUMNS_HERE", ", ".join(
        f"CAST(coalesce(o_orderstatus, mo) = '{v}' AS INT)::DOUBLE AS \"o_orderstatus_{v}\"" for v in "FOP")),
    "ml_split": f"SELECT event_id, r <= round(n * 0.2) AS is_test FROM ({hash_rank(42)})",
    "cv_folds": f"SELECT event_id, CAST(((r - 1) * 5) // n AS BIGINT) AS fold FROM ({hash_rank(42)})",
    "regression_metrics": WITH_SCORED + """SELECT count(*) AS n, round(avg(abs(target - guess)), 6) AS mae, round(avg(pow(target - guess, 2)), 6) AS mse,
  round(sqrt(avg(pow(target - guess, 2))), 6) AS rmse, round(1 - avg(pow(target - guess, 2)) / var_pop(target), 6) AS r2 FROM scored""",
    "classification_metrics": WITH_SCORED + """, c AS (SELECT DISTINCT label AS c FROM scored UNION SELECT DISTINCT prediction FROM scored),
p AS (SELECT c, (SELECT count(*) FROM scored WHERE label = c) AS s, (SELECT count(*) FROM scored WHERE prediction = c) AS k,
  (SELECT count(*) FROM scored WHERE prediction = c AND label = c) AS h FROM c),
q AS (SELECT s, h, CASE WHEN k > 0 THEN h / k ELSE 0 END AS p, CASE WHEN s > 0 THEN h / s ELSE 0 END AS r FROM p)
SELECT CAST(sum(s) AS BIGINT) AS n, round(sum(h) / sum(s), 6) AS accuracy, round(sum(s * p) / sum(s), 6) AS precision, round(sum(s * r) / sum(s), 6) AS recall,
  round(sum(s * CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) / sum(s), 6) AS f1 FROM q""",
    "confusion_matrix": WITH_SCORED + """, c AS (SELECT DISTINCT label AS c FROM scored UNION SELECT DISTINCT prediction FROM scored)
SELECT a.c AS label, b.c AS prediction, (SELECT count(*) FROM scored s WHERE s.label = a.c AND s.prediction = b.c) AS count FROM c a, c b""",
    "roc_auc": WITH_SCORED + """, r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS k FROM scored),
s AS (SELECT count(*) FILTER (WHERE y) AS p, count(*) FILTER (WHERE NOT y) AS n, sum(k) FILTER (WHERE y) AS k FROM r)
SELECT round((k - p * (p + 1) / 2.0) / (p * n), 6) AS roc_auc, p AS positives, n AS negatives FROM s""",
    "knn_predict": KNN_SQL,
    "ml_linear_folds": FOLDS_SQL,
}
